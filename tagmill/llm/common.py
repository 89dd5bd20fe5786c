"""Helpers shared by the training-data operators: shared tables, text hashing, components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed patterns: words are runs of anything but these six white-space bytes.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

#: A side of a join may be broadcast up to so many rows of one or two numbers; beyond it, the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Rows of one key that a task of split_join takes, at least, if rows are wide or of a few numbers, and keys with more rows than a task takes, at most.
CHUNK, NARROW, HOT_KEYS = 256, 8192, 100_000
#: Groups of one stretch of running_sums.
STRETCH = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one stands in on a single machine only; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tagmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def held(spark: SparkSession, key: str, value):
    """Within, a setting of the session has this value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles of the writing go with it; else they stay on the executors' disks until the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with held(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stashed_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later step reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stashed_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast behind a check of the counted rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def arrow_batches(spark: SparkSession, size: int):
    """Within, tables are written with about so many bytes at most in a batch for Python, however long their rows are."""
    return held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def words(text: str = "text") -> Column:
    """The number of words of a text, 0 for null: what is left when each word is one letter and white space is gone."""
    marks = F.translate(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORDS, "w"), "\t\n\x0b\f\r ", "")
    return F.length(marks).cast("long")


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Hashing of words and shingles, a chunk of documents at a time.

#: Words are hashed modulo this prime, in which polynomials have few roots, unlike modulo a power of two.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 1_423_908_151_672_389_173
_LOW32, _LOW31, _LOW30, _LOW29 = (np.uint64((1 << k) - 1) for k in (32, 31, 30, 29))
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at a time, and the longest word that is hashed as a polynomial; longer ones take a digest.
_PART, _LONG = 1 << 15, 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below it, from parts of 31 bits: 2^61 is 1 and 2^62 is 2."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + a0 * b0)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base as low and high 32 bits, and the powers of its inverse."""
    found = []
    for base in (_BASE, pow(_BASE, -1, (1 << 61) - 1)):
        p = np.ones(1, np.uint64)
        while len(p) < _PART:
            p = np.concatenate((p, mulmod(p, np.full(len(p), pow(base, len(p), (1 << 61) - 1), np.uint64))))
        found.append(p)
    return found[0] & _LOW32, found[0] >> np.uint64(32), found[1]


def chunks(column, limit: int = 1 << 18):
    """Cut an Arrow string column into (first row, bytes, document offsets); nulls are empty, long texts whole."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = column.type == "large_string"
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def word_spans(low: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words (runs of bytes that are not blank) of a chunk begin and end, and each document's first word."""
    n = len(low)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_blank = blank[low]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, is_blank[:-1]
    before[full] = True
    after[-1], after[:-1] = True, is_blank[1:]
    after[full[1:] - 1] = True
    first = np.flatnonzero(~is_blank & before)
    return first, np.flatnonzero(~is_blank & after) + 1, np.searchsorted(first, offsets)


def span_hashes(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: polynomials modulo 2^61 - 1 in a fixed base, with the length, scrambled.

    Different words agree with a chance of their length in 2^61, whatever their structure. Long texts go part by part.
    """
    h = np.empty(len(first), np.uint64)
    for k in np.flatnonzero(last - first > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(low[first[k] : last[k]].tobytes(), digest_size=8).digest(), "little") >> 3
    short = np.flatnonzero(last - first <= _LONG)
    lo, hi, inverse = _powers()
    at, ends = first[short], last[short]
    i = 0
    while i < len(short):
        j = int(np.searchsorted(ends, at[i] + _PART, "right"))
        start, size = at[i], ends[j - 1] - at[i]
        byte = low[start : start + size].astype(np.uint64) + np.uint64(1)
        a, b = at[i:j] - start, ends[i:j] - start
        sums = []
        for power in (lo, hi):  # running sums may wrap; those of one word are below 2^57
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(byte * power[:size], out=total[1:])
            sums.append(total[b] - total[a])
        high = _reduced(sums[1])  # times 2^32 modulo 2^61 - 1: a rotation of 61 bits
        value = _reduced(_reduced(sums[0]) + (((high & _LOW29) << np.uint64(32)) | (high >> np.uint64(29))))
        h[short[i:j]] = mulmod(value, inverse[a])
        i = j
    return mix(h + (last - first).astype(np.uint64) * _P)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of a chunk, and each document's first word."""
    low = _LOWER[raw]
    first, last, words = word_spans(low, offsets, blank)
    return span_hashes(low, first, last), words


def shingle_sets(column, width: int):
    """Yield (row, sorted distinct 64-bit shingle hashes) of each text; fewer words than width form one shingle."""
    for row, raw, offsets in chunks(column):
        h, words = word_hashes(raw, offsets)
        s = h[: max(0, len(h) - width + 1)]
        for k in range(1, width):
            s = mix(s * _P + h[k : k + len(s)])
        for i in range(len(offsets) - 1):
            a, b = words[i], words[i + 1]
            if b - a >= width:
                yield row + i, np.unique(s[a : b - width + 1])
            elif b > a:
                one = h[a : a + 1]
                for k in range(a + 1, b):
                    one = mix(one * _P + h[k : k + 1])
                yield row + i, mix(one + np.uint64(b - a))
            else:
                yield row + i, np.zeros(0, np.uint64)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner", chunk: int | None = None, over: DataFrame | None = None) -> DataFrame:
    """left (of so many rows) joined with right, which has one row of each key; a hot key's rows are dealt over several tasks.

    Rows of left are counted by key, pre-aggregated. A key with more than `chunk` rows is dealt over as many parts as it has
    chunks, and right's row of it is repeated for each. There are at most HOT_KEYS such keys, so their list may be broadcast.
    `over` is a table that left comes from by such joins, with no more columns and no fewer rows: it is counted instead, as a
    plan that counts what it joins holds left twice, and one of joins within joins twice for each.
    """
    chunk = max(chunk or CHUNK, -(-rows // HOT_KEYS))
    if rows <= chunk:
        return left.join(right, keys, how)
    over = left if over is None else over
    counted = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > chunk)
    hot = F.broadcast(counted.select(*keys, F.ceil(F.col("_rows") / chunk).cast("long").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*over.columns), parts)).drop("_parts")
    copies = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def running_sums(rows: DataFrame, keys: list[str], group: str, order: list[str], value: str) -> DataFrame:
    """rows with `before`: the sum of value over the rows with equal keys that stand earlier by (group, *order).

    group counts from 0. Sums run within groups, over the groups of a stretch, and over stretches, so no task sums a whole
    key. Where groups begin is a table of a row for each, so a plan with several such sums doesn't hold rows three times for each. Keys must not be null.
    """

    def earlier(name: str, by: list[str], *order: str) -> Column:
        return F.coalesce(F.sum(name).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    groups = rows.groupBy(*keys, group).agg(F.sum(value).alias("_m")).withColumn("_s", F.floor(F.col(group) / STRETCH))
    stretches = groups.groupBy(*keys, "_s").agg(F.sum("_m").alias("_t")).select(*keys, "_s", earlier("_t", keys, "_s").alias("_over"))
    groups = groups.withColumn("_in", earlier("_m", [*keys, "_s"], group)).join(stretches, [*keys, "_s"]).select(*keys, group, (F.col("_in") + F.col("_over")).alias("_base"))
    groups = stash(groups, "sums")
    summed = rows.withColumn("before", earlier(value, [*keys, group], *order)).join(groups, [*keys, group])
    return summed.withColumn("before", F.col("before") + F.col("_base")).drop("_base")


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """rows with `rank`, the number of rows with a smaller value of the column: unique, not null.

    A bounded sample of values only sets where the groups begin in which rows are numbered; ranks are exact.
    """
    bounds = sorted(r[0] for r in rows.select(column).orderBy(F.xxhash64(column)).limit(1000).collect())
    group = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<string>"), lambda b: b <= F.col(column))).cast("long")
    return running_sums(rows.withColumn("_g", group).withColumn("_one", F.lit(1)), [], "_g", [column], "_one").drop("_g", "_one").withColumnRenamed("before", "rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge (a, b); component is the smallest node that links reach.

    Each round points every node to its smallest neighbour, doubles the pointers until all end at a root, and contracts the
    edges to the roots, of which at least half go. Minima are pre-aggregated and hubs' rows are dealt over several tasks.
    Each step's table is written to the shared folder; those no later step needs are deleted. Empty edges give no rows.
    """
    edges = stash(edges.select("a", "b").where("a <> b").distinct(), "edges")
    n, rounds = edges.count(), []
    while n:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("node", "to")
        up = stash(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")), "pointers")
        nodes, moved = up.count(), True
        while moved:
            step = split_join(up.select("node", "up"), up.select(F.col("node").alias("up"), F.col("up").alias("top")), ["up"], nodes, chunk=NARROW)
            step = stash(step.select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "pointers")
            moved = not step.where("moved").isEmpty()
            discard(up)
            up = step
        up = up.select("node", "up")
        rounds.append((up, nodes))
        at_a, at_b = (up.toDF(c, f"r{c}") for c in "ab")
        left = split_join(split_join(edges, at_a, ["a"], n, chunk=NARROW), at_b, ["b"], n, chunk=NARROW, over=edges).where("ra <> rb")
        left = stash(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(edges)
        edges, n = left, left.count()
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found, _ = rounds.pop()
    while rounds:  # from the last round's roots back to the first round's nodes
        up, nodes = rounds.pop()
        found = split_join(up, found.toDF("up", "top"), ["up"], nodes, "left", chunk=NARROW).select("node", F.coalesce("top", "up").alias("up"))
        found = stash(found, "components")
    return found.toDF("node", "component")
