"""Length buckets of least padding by dynamic programming, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import running_sums, stash, words

#: Documents of one group that a task numbers.
GROUP = 2048


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` groups of ascending lengths, with the least total of counts * end - tokens.

    cost[k][j] = min over i of cost[k-1][i] + end_j * (C_j - C_i) - (T_j - T_i). The best i never falls as j grows, so
    each layer is solved by halving j's range between the best i of its ends, all ranges of a depth at once.
    """
    n = len(lengths)
    if n == 0:
        return []
    end = np.concatenate(([0], lengths)).astype(np.float64)
    c = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    t = np.concatenate(([0], np.cumsum(tokens))).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choice = []
    for _ in range(min(buckets, n)):
        new, best = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        a, b, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(a):
            j = (a + b) // 2
            size = np.minimum(high, j - 1) - low + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) + np.repeat(low - start, size)
            at = np.repeat(j, size)
            total = cost[i] + end[at] * (c[at] - c[i]) - (t[at] - t[i])
            least = np.minimum.reduceat(total, start)
            hit = np.flatnonzero(total == np.repeat(least, size))
            first = hit[np.searchsorted(hit, start)]
            new[j], best[j] = least, i[first]
            a, b, low, high = np.concatenate((a, j + 1)), np.concatenate((j - 1, b)), np.concatenate((low, best[j])), np.concatenate((best[j], high))
            left = a <= b
            a, b, low, high = a[left], b[left], low[left], high[left]
        choice.append(best)
        cost = new
    ends, j = [], n
    for best in reversed(choice):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(best[j])
    return ends[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 16384, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, length, bucket_length, batch_id, position, padding.

    The histogram of lengths (words unless a length column is given) goes to the driver, a row of three numbers for each
    distinct length. L distinct lengths need L * L / 2 tokens at least, so a corpus of W tokens has at most
    sqrt(2 W) + 1 of them: 6 million for 100 TB of text. Dynamic programming picks the boundaries of least padding among
    all of them. A batch of a bucket holds as many documents as the
    token budget allows at the bucket's length, one at least. Documents are dealt by hash into groups of about GROUP
    within their bucket; each group is numbered by itself, and the groups' counts give each its first number, so batches
    are full except one per bucket, and no bucket is handled by one task.

    Null and empty texts have length 0 and a bucket like others (of length 0, if the least padding says so); a batch of
    length 0 counts as length 1. Repeated rows are packed each. Other columns are ignored; an empty table gives no rows.
    """
    sized = docs.select("doc_id", (words() if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("length"))
    sized = stash(sized, "lengths")
    table = sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")
    lengths, n = table["length"].to_numpy(), table["n"].to_numpy()
    ends = best_boundaries(lengths, n, lengths * n, buckets)
    if not ends:
        return sized.selectExpr("doc_id", "length", "length as bucket_length", "cast(null as string) as batch_id", "length as position", "length as padding")
    of = np.searchsorted(ends, lengths)
    bucket, groups = F.lit(ends[-1]), F.lit(1)
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("length") <= end, end).otherwise(bucket)
    for k, end in enumerate(ends):
        groups = F.when(F.col("bucket_length") == end, max(1, -(-int(n[of == k].sum()) // GROUP))).otherwise(groups)
    placed = sized.withColumn("bucket_length", bucket.cast("long")).withColumn("r", F.xxhash64("doc_id", F.lit(seed)))
    placed = placed.withColumn("g", F.pmod("r", groups.cast("long"))).withColumn("one", F.lit(1))
    numbered = running_sums(placed, ["bucket_length"], "g", ["r", "doc_id", "length"], "one")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return numbered.select(
        "doc_id", "length", "bucket_length",
        F.concat_ws("-", "bucket_length", F.floor(F.col("before") / room)).alias("batch_id"),
        F.pmod(F.col("before"), room).cast("long").alias("position"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )
