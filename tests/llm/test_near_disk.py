"""What near dedup writes: pairs of long texts that only share passages are not compared whole, and shuffles go with the table they were made for."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tagmill.llm import common, partenum


def sides(sets, num, den):
    bits = [partenum.wide_bits(len(s), num, den) for s in sets]
    wide = [partenum.parities(s, b) if b > partenum.SKETCH_BITS else np.zeros(0, np.uint64) for s, b in zip(sets, bits, strict=True)]
    return np.array([len(s) for s in sets]), np.array([partenum.parities(s, partenum.SKETCH_BITS) for s in sets]), np.array([len(w) for w in wide]), wide


def test_long_texts_that_share_a_passage_are_not_compared_whole(spark, monkeypatch):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(600)]
    texts = [passage + [f"w{rng.randrange(1 << 40)}" for _ in range(3000)] for _ in range(40)]
    texts.append([*texts[11][:-100], *(f"x{k}" for k in range(100))])  # a near copy of the twelfth
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    whole = []

    def stash(df, tag, write=common.stash):
        found = write(df, tag)
        if tag == "members":
            whole.append(found.count())
        return found

    monkeypatch.setattr(partenum, "stash", stash)
    rows = {r.doc_id: r.component_id for r in partenum.jaccard_components(docs, 5, 80, 100).collect()}
    assert rows == {k: 11 if k == 40 else k for k in range(41)}
    assert sum(whole) == 2


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100), (50, 100), (30, 100)])
def test_sketches_rule_out_no_similar_sets(num, den):
    rng = np.random.default_rng(3)
    for size in (40, 1500, 1843, 1844, 3600, 3700, 9000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets = [base]
        for other in (num * size // den, size * num // den + size // 20, size, min(size * den // num, 2 * size)):
            kept = min(size, other, -(-num * (size + other) // (den + num)))  # the least overlap of that likeness
            sets.append(np.concatenate((base[:kept], rng.integers(0, 1 << 63, other - kept, dtype=np.uint64))))
        apart = [rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(3)]
        i = np.array([0] * (len(sets) - 1 + 3))
        j = np.arange(1, len(sets) + 3)
        _, left = partenum.possible(sides(sets + apart, num, den), i, j, num, den)
        similar = {k for k in range(1, len(sets)) if len(np.intersect1d(base, sets[k])) * den >= num * len(np.union1d(base, sets[k]))}
        assert similar and similar <= set(left.tolist())
        assert num < 80 or not set(left.tolist()) & set(range(len(sets), len(sets) + 3))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_tiles_meet_each_pair_of_components(size):
    rng = np.random.default_rng(5)
    sets, rows = [], []
    for k in range(60):
        s = sets[k - 1] if k % 3 else rng.integers(0, 1 << 63, 60 if k % 2 else 3000, dtype=np.uint64)
        sets.append(np.concatenate((s[:-1], rng.integers(0, 1 << 63, 1, dtype=np.uint64))))
    n, parity, _, wide = sides(sets, 80, 100)
    tile, component = rng.integers(0, 3, 60), rng.integers(0, 30, 60)
    for sig, members in ((5, range(60)), (9, range(20, 50)), (11, range(3))):
        rows += [(sig, min(tile[k], h), max(tile[k], h), tile[k], k, component[k], n[k], parity[k].view(np.int64).tolist(), wide[k].view(np.int64).tolist()) for k in members for h in range(3)]
    rows.sort(key=lambda r: r[:3])
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size], strict=True), kinds, strict=True)], names=list("abcdefghi")) for k in range(0, len(rows), size)]
    found = {(x, y) for b in partenum._apart(iter(batches), 80, 100) for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)}
    like = lambda x, y: len(np.intersect1d(x, y)) * 100 >= 80 * len(np.union1d(x, y))
    wanted = {(x, y) for x in range(60) for y in range(x + 1, 60) if component[x] != component[y] and like(sets[x], sets[y])}
    assert wanted and wanted == found


def test_shuffles_go_with_the_table_they_were_made_for(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, end = shuffles(), time.time() + 20
    rows = common.stash(spark.range(1000).selectExpr("id % 10 as k").groupBy("k").count(), "counts")
    while shuffles() - before and time.time() < end:  # they are deleted beside the driver's work
        time.sleep(0.2)
    assert not shuffles() - before
    assert rows.count() == 10
