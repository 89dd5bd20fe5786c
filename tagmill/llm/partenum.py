"""Jaccard self-join on word shingles by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import NARROW, arrow_batches, connected_components, discard, mix, shingle_sets, small, split_join, stash

#: Sizes from one band's start to its end grow by this factor.
BAND = 1.5
#: Second-level partitions of each first-level one, and how many of them may differ.
SECOND, DIFFER = 2, 1
#: Subsets with members that the smallest set of a band should have beyond those that differences can spoil, as a share of these.
SPARE = 0.04
#: Partitionings that a set tries at most; in the last one, subsets without members count as well.
TRIES = 32
#: Bytes of a batch handed to Python, and shingles of a batch handed back, at most unless one row has more; words of sketches compared at a time.
BATCH_BYTES, BATCH_SHINGLES, PAIR_WORDS = 8 << 20, 1 << 20, 1 << 18
#: Bits of a parity sketch, and of the wide one of a larger set, at most; members of one tile of a signature.
SKETCH_BITS, WIDE_BITS, TILE = 1024, 1 << 16, 8192


@lru_cache(maxsize=65536)
def band_of(size: int) -> tuple[int, int, int]:
    """(band, smallest, largest size): bands tile the sizes from 1 up."""
    k, low = 0, 1
    while True:
        high = max(low, int(low * BAND))
        if size <= high:
            return k, low, high
        k, low = k + 1, high + 1


@lru_cache(maxsize=1024)
def layout(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """(first-level partitions, subsets sure to agree) for sets of a band, and those of the band before that may match them.

    Two sets of at most high members with Jaccard >= num/den differ in at most k = 2 high (den - num) / (den + num) members.
    Each difference spoils at most a fixed number of subsets; what is left over is sure to agree. There are enough partitions
    that even the smallest such set is expected to have more subsets with members than can be spoiled. k = 0 gives no
    partitions: such sets are equal.
    """
    k = 2 * high * (den - num) // (den + num)
    if k == 0:
        return 0, 0
    take = SECOND - DIFFER
    least = max(1, num * low // den)
    spoil = [comb(SECOND - d - 1, take - 1) for d in range(DIFFER + 1)]  # by the (d+1)-th differing part of a partition
    first = ceil((k + 1) / (DIFFER + 1))
    while True:
        left, spoiled = k, 0
        for cost in spoil:
            used = min(left, first)
            spoiled, left = spoiled + used * cost, left - used
        subsets = first * comb(SECOND, take)
        filled = subsets * (1 - exp(-least * take / (first * SECOND)))
        if subsets > spoiled and (filled >= spoiled * (1 + SPARE) + 0.5 or first > 2 * least):
            return first, subsets - spoiled
        first += 1


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set of 64-bit features; any two sets with Jaccard >= num/den that are not equal share one."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.uint64)
    band, low, high = band_of(n)
    wanted = [(band, low, high)]
    _, low, high = band_of(high + 1)
    if n * den >= num * low:  # large enough to match sets of the next band
        wanted.append((band + 1, low, high))
    out = []
    picks = list(combinations(range(SECOND), SECOND - DIFFER))
    for band, low, high in wanted:
        first, sure = layout(low, high, num, den)
        seed = 0
        while first:
            key = np.uint64(((seed * 1_000_003 + band) * 2_654_435_761 + 97) % (1 << 64))
            h = mix(s ^ key)
            cell = (h >> np.uint64(20)) % np.uint64(first * SECOND)
            order = np.argsort(cell)
            cell, value = cell[order].astype(np.int64), mix(h[order])
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            total, filled = np.zeros(first * SECOND, np.uint64), np.zeros(first * SECOND, bool)
            total[cell[start]], filled[cell[start]] = np.add.reduceat(value, start), True
            total, filled = total.reshape(first, SECOND), filled.reshape(first, SECOND)
            empty = 0
            for at, pick in enumerate(picks):
                full = filled[:, pick].any(axis=1) | (seed == TRIES - 1)
                where = np.flatnonzero(full).astype(np.uint64) * np.uint64(len(picks)) + np.uint64(at)
                out.append(mix(total[full][:, pick].sum(axis=1, dtype=np.uint64) ^ mix(where + key)))
                empty += int((~full).sum())
            if empty < sure:  # one of the subsets that agree is among those emitted
                break
            seed += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def wide_bits(size: int, num: int, den: int) -> int:
    """Bits that a set's wide sketch needs so that sets without common members differ in clearly more bits than similar ones may."""
    need = 5 * size * (den - num) // (den + num)
    return min(WIDE_BITS, 1 << max(0, need - 1).bit_length())


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """Of each of so many cells (a power of two), whether an odd number of members falls into it, as 64-bit words.

    Twice as many cells, their second half combined with the first by exclusive or, give the same words.
    """
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1).view(np.uint64)


def _sketch(sets: DataFrame, width: int, num: int = 0, den: int = 0, sigs: bool = False, parity: bool = False, whole: bool = False) -> DataFrame:
    """(doc_id, n, h1, h2) of each text's shingle set; with sigs its signatures, with parity its sketches, with whole the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0), []
            group: list[tuple[int, np.ndarray]] = []
            held = 0
            for row, s in shingle_sets(batch.column(1), width):
                group.append((row, s))
                held += len(s)
                if len(group) == 512 or held >= BATCH_SHINGLES:
                    yield emit(ids, group)
                    group, held = [], 0
            if group:
                yield emit(ids, group)

    def emit(ids: pa.Array, group: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        rows, sets_ = [r for r, _ in group], [s for _, s in group]
        with np.errstate(over="ignore"):
            h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets_]).view(np.int64)
            h2 = np.array([mix(mix(s) + np.uint64(1)).sum(dtype=np.uint64) for s in sets_]).view(np.int64)
        columns = [ids.take(pa.array(rows)), pa.array([len(s) for s in sets_], pa.int64()), pa.array(h1), pa.array(h2)]
        names = ["doc_id", "n", "h1", "h2"]
        if sigs:
            columns, names = [*columns, _lists([signatures(s, num, den) for s in sets_])], [*names, "sigs"]
        if parity:
            bits = [wide_bits(len(s), num, den) for s in sets_]
            wide = [parities(s, b) if b > SKETCH_BITS else np.zeros(0, np.uint64) for s, b in zip(sets_, bits, strict=True)]
            columns, names = [*columns, _lists([parities(s, SKETCH_BITS) for s in sets_]), _lists(wide)], [*names, "parity", "wide"]
        if whole:
            columns, names = [*columns, _lists(sets_)], [*names, "members"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n long, h1 long, h2 long" + ", sigs array<long>" * sigs + ", parity array<long>, wide array<long>" * parity + ", members array<long>" * whole
    return sets.select("doc_id", "text").mapInArrow(run, schema)


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy()


def _sides(n: pa.Array, parity: pa.ListArray, wide: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a batch's rows the sizes, the sketches, and the lengths and words of the wide sketches."""
    at, bits = _ragged(parity)
    ends, words = _ragged(wide)
    found = [words[x:y].view(np.uint64) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return n.to_numpy(), bits[at[0] : at[-1]].reshape(len(n), SKETCH_BITS // 64).view(np.uint64), np.diff(ends), found


def _joined(parts: list[tuple]) -> tuple:
    """The parts' rows one after another; each part is a tuple of columns, the last one a list."""
    if len(parts) == 1:
        return parts[0]
    *columns, wide = zip(*parts, strict=True)
    return (*map(np.concatenate, columns), sum(wide, []))


def possible(sides: tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows those that sizes and parity sketches leave possible: sketches differ in no more bits than the sets in members.

    Wide sketches are compared at the length of the shorter one; those of sets without one rule nothing out.
    """
    n, parity, words, wide = sides

    def few(apart: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return apart.astype(np.int64) * (den + num) <= (n[i] + n[j]) * (den - num)

    fit = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
    i, j = i[fit], j[fit]
    fit = few(np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64), i, j)
    i, j = i[fit], j[fit]
    shared = np.minimum(words[i], words[j])
    if not shared.any():
        return i, j
    fit = np.ones(len(i), bool)
    for length in np.unique(shared[shared > 0]):
        at = np.flatnonzero(shared == length)
        rows, where = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
        folded = np.array([np.bitwise_xor.reduce(wide[k].reshape(-1, length), axis=0) for k in rows])
        x, y = where[: len(at)], where[len(at) :]
        step = max(1, PAIR_WORDS // length)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            fit[part] = few(np.bitwise_count(folded[x[k : k + step]] ^ folded[y[k : k + step]]).sum(axis=1, dtype=np.int64), i[part], j[part])
    return i[fit], j[fit]


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard >= num/den, by exact intersection; a table in the shared folder."""

    def likely_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = PAIR_WORDS * 64 // SKETCH_BITS
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = np.arange(batch.num_rows)
                keep, _ = possible(_joined([_sides(*batch.columns[2:5]), _sides(*batch.columns[5:8])]), rows, rows + batch.num_rows, num, den)
                yield batch.select(["a", "b"]).take(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (oa, va), (ob, vb) = _ragged(batch.column(2)), _ragged(batch.column(3))
            keep = []
            for k in range(batch.num_rows):
                x, y = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if shared * den >= num * (len(x) + len(y) - shared):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), batch.column(1).take(pa.array(keep, pa.int32()))], names=["a", "b"])

    # Sizes and sketches first: they are a fortieth of the sets, and most pairs that only share a passage end here.
    sketches = sketches.select("doc_id", "n", "parity", "wide")
    count = pairs.count()
    likely = split_join(pairs, sketches.toDF("a", "na", "pa", "wa"), ["a"], count, chunk=NARROW)
    likely = split_join(likely, sketches.toDF("b", "nb", "pb", "wb"), ["b"], count, chunk=NARROW, over=pairs)
    likely = likely.select("a", "b", "na", "pa", "wa", "nb", "pb", "wb").mapInArrow(likely_ones, "a long, b long")
    likely = stash(likely.distinct(), "likely")
    wanted = stash(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(small(wanted, wanted.count()), "doc_id", "left_semi")
    sides = stash(_sketch(texts, width, whole=True).select("doc_id", "members"), "members")
    count = likely.count()
    joined = split_join(split_join(likely, sides.toDF("a", "ma"), ["a"], count), sides.toDF("b", "mb"), ["b"], count, over=likely).select("a", "b", "ma", "mb")
    links = stash(joined.mapInArrow(run, "a long, b long"), "links")
    discard(likely, wanted, sides)
    return links


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, cid) in order: (sig, cid, hub, false) of every member of a signature after its first, the hub; and
    (sig, hub, hub, true) of the partition's first and last signature, whose members may go on in other partitions."""

    def emit(sig, cid, hub, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(cid, pa.int64()), pa.array(hub, pa.int64()), pa.array(np.full(len(sig), edge))], names=["sig", "cid", "hub", "edge"])

    last: tuple[int, int] | None = None
    for batch in batches:
        sig, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        first = last is None
        start = np.r_[first or sig[0] != last[0], sig[1:] != sig[:-1]]
        at = np.maximum.accumulate(np.where(start, np.arange(len(sig)), -1))
        hub = np.where(at >= 0, cid[at], 0 if first else last[1])
        if first:
            yield emit(sig[:1], hub[:1], hub[:1], True)
        yield emit(sig[~start], cid[~start], hub[~start], False)
        last = int(sig[-1]), int(hub[-1])
    if last is not None:
        yield emit([last[0]], [last[1]], [last[1]], True)


def _apart(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, ti, tj, t, cid, component, n, parity, wide) in order of their key, the first three: the pairs (a, b) of a key's
    rows from different components, one of tile ti and one of tj, that sizes and sketches leave possible. Rows of a key are held, pairs only so many at a time."""

    def pairs(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ti, tj, t, cid, component, *side = _joined(parts)
        n, step = side[0], PAIR_WORDS * 64 // SKETCH_BITS
        if (component == component[0]).all():
            return
        xs, ys = np.flatnonzero(t == ti), np.flatnonzero(t == tj)
        ys = ys[np.argsort(n[ys], kind="stable")]
        low = np.searchsorted(n[ys], -(-n[xs] * num // den), "left")  # sizes that may match
        high = np.searchsorted(n[ys], n[xs] * den // num, "right") if num else np.full(len(xs), len(ys))
        upto = np.cumsum(high - low)
        k = 0
        while k < len(xs):
            stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + step, "right")))
            size = (high - low)[k:stop]
            i = np.repeat(xs[k:stop], size)
            j = ys[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[k:stop], size)]
            new = (component[i] != component[j]) & ((cid[i] < cid[j]) | (ti[0] != tj[0]))
            i, j = possible(side, i[new], j[new], num, den)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j]))], names=["a", "b"])
            k = stop

    held: list[tuple] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns[:6]]
        rows = (*columns[1:], *_sides(*batch.columns[6:]))
        key = np.column_stack(columns[:3])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (a or not np.array_equal(key[0], last)):
                yield from pairs(held)
                held = []
            held.append(tuple(column[a:b] for column in rows))
        last = key[-1]
    if held:
        yield from pairs(held)


def _crossing(open_: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that share a signature and that sizes and parity sketches leave possible.

    open_ has (sig, cid, component) without those hubs whose pairs are all verified already. Signatures with the same
    members are taken once. Members are dealt into tiles, so that no task holds more than two tiles of a signature's rows; what
    sizes and sketches rule out is never written.
    """
    spans = open_.groupBy("sig").agg(
        F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.min("cid").alias("first"), F.bit_xor(F.xxhash64("cid")).alias("f1"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("f2"),
    )
    spans = spans.where("lo <> hi").groupBy("m", "first", "f1", "f2").agg(F.min("sig").alias("sig"))
    spans = spans.select("sig", F.ceil(F.col("m") / TILE).cast("long").alias("g"))
    dealt = (
        split_join(open_, spans, ["sig"], open_.count(), chunk=NARROW).join(sketches.select(F.col("doc_id").alias("cid"), "n", "parity", "wide"), "cid")
        .withColumn("t", F.pmod(F.xxhash64("cid"), F.col("g")))
        .withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        .select("sig", F.least("t", "h").alias("ti"), F.greatest("t", "h").alias("tj"), "t", "cid", "component", "n", "parity", "wide")
    )
    dealt = stash(dealt, "tiles")
    met = dealt.repartition("sig", "ti", "tj").sortWithinPartitions("sig", "ti", "tj")
    return met.mapInArrow(lambda batches: _apart(batches, num, den), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Two documents link when the Jaccard similarity of their shingle sets is at least num/den.

    1. Sets are folded by a 128-bit hash, so copies are one class, whose smallest doc_id stands for it.
    2. Each class emits PartEnum signatures: the feature domain is partitioned in two levels and subsets of the second
       level are enumerated, by bands of set sizes, so that similar sets are certain to share one signature. Subsets
       without members are no evidence and are left out; a set with too many of them draws further partitionings until it
       has enough others.
    3. Ranges of (signature, class) bring equal signatures together, a hot one's over several tasks. Each member is paired
       with the first of its signature in its task, and these with the smallest of all, not every member with every
       other; distinct pairs are verified by exact intersection and joined into components.
    4. Signatures that still span several components are compared across those components, in tiles of bounded size;
       rigorous size and parity-sketch bounds drop impossible pairs, the rest are verified exactly. Pairs within a
       component can't change it. So no link between different components is lost.

    Null, empty or blank texts have no shingles, link with nothing and are their own component. Repeated rows are copies of
    each other; different texts under one id count as one document's. Rows with a null doc_id are returned with a null component. Other columns are ignored; an empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _components(docs, width, num, den)


def _components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    members = stash(_sketch(docs, width), "sets")
    key = ["n", "h1", "h2"]
    filled = members.where("n > 0 and doc_id is not null")
    classes = filled.groupBy(*key).agg(F.min("doc_id").alias("cid"))

    first = stash(classes.select(F.col("cid").alias("doc_id")).distinct(), "classes")
    texts = docs.select("doc_id", "text").join(small(first, first.count()), "doc_id", "left_semi")
    signed = stash(_sketch(texts, width, num, den, sigs=True).where("n > 0").select("doc_id", "sigs"), "signed")
    spread = signed.select(F.explode("sigs").alias("sig"), F.col("doc_id").alias("cid")).repartitionByRange("sig", "cid").sortWithinPartitions("sig", "cid")
    rows = stash(spread.mapInArrow(_sharing, "sig long, cid long, hub long, edge boolean"), "signatures")
    discard(signed, first)

    # The few signatures that go on from one task to the next: their first members are paired with the smallest of all.
    parted = rows.where("edge").groupBy("sig").agg(F.min("hub").alias("top"), F.max("hub").alias("last")).where("top <> last").select("sig", "top")
    edges = rows.where("edge").join(F.broadcast(parted), "sig").select("sig", "cid", "top").distinct()
    pairs = rows.where("not edge").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    pairs = stash(pairs.union(edges.select("top", "cid")).where("a <> b").distinct(), "pairs")
    members_of = rows.where("not edge").select("sig", "cid").union(edges.select("sig", "cid"))
    wanted = stash(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(small(wanted, wanted.count()), "doc_id", "left_semi")
    sketches = stash(_sketch(texts, width, num, den, parity=True), "sketches")
    links = _verified(docs, pairs, sketches, width, num, den)
    parts = connected_components(links)

    def placed(ids: DataFrame, parts: DataFrame) -> DataFrame:
        named = parts.withColumnRenamed("node", "cid")
        return ids.join(named, "cid", "left").withColumn("component", F.coalesce("component", "cid"))

    open_ = stash(placed(members_of, parts), "open")
    discard(rows)
    more = _crossing(open_, sketches, num, den)
    more = stash(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        more = _verified(docs, more, sketches, width, num, den)
        if not more.isEmpty():
            parts = connected_components(links.union(more))

    named = placed(classes, parts).select(*key, F.col("component").alias("component_id"))
    found = split_join(filled, named, key, members.count(), chunk=NARROW).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = members.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest)


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with all their columns.

    Texts without words, null ones among them, and rows without a doc_id stay. Rows that repeat a doc_id stay or go together.
    """
    kept = jaccard_components(docs, width, num, den).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")
