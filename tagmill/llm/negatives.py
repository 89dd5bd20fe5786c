"""Hard negatives: integer scores of anchors against all rows, in blocks, sorted in a shuffle and read as a stream of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import stash

#: Anchors and rows of one task's tile, about.
ANCHORS, ROWS = 4096, 16384
_LONG = (1 << 63) - 1
#: What is sorted: a pair's key is (anchor, descending score, id).
_PAIR = "anchor_id long, falling long, row_id long, positive boolean"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, given as doubles; those beyond 64 bits stop at their ends."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -_LONG, _LONG).astype(np.int64)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores n with low * positive <= 100 * n <= high * positive, of a positive score that isn't negative."""
    return -(-low * positive // 100), high * positive // 100


def _tile(positives: int, negatives: int, low: int, high: int, second: bool):
    """The pairs of one tile that may matter: first each anchor's best rows of its own label, then, once all tiles' positives
    are known, the first negatives of each window. Scores below 0 open no window and lie in none."""

    def tile(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not len(anchors) or not len(rows):
            return pd.DataFrame({"anchor_id": [], "falling": [], "row_id": [], "positive": []})
        rows = rows.sort_values("row_id", kind="stable")
        ids, labels = rows["row_id"].to_numpy(), rows["row_label"].to_numpy()
        product = scores(*(np.array(x.tolist(), np.float64).reshape(len(x), key[2]) for x in (anchors["code"], rows["row_code"])))
        for k, (anchor, label) in enumerate(zip(anchors["vec_id"], anchors["label"], strict=True)):
            s = product[k]
            if second:
                spans = [window(int(p), low, high) for p in anchors["best"].iloc[k]]
                at = np.flatnonzero((labels != label) & (s >= min(x for x, _ in spans)) & (s <= max(y for _, y in spans)))
            else:
                at = np.flatnonzero((labels == label) & (ids != anchor) & (s >= 0))
                if len(at) > positives:  # those that tie with the last one stay for now
                    at = at[s[at] >= np.partition(s[at], -positives)[-positives]]
            at = at[np.argsort(-s[at], kind="stable")]
            if second:
                falling = -s[at]
                found = [at[np.searchsorted(falling, -y) : np.searchsorted(falling, -x, "right")][:negatives] for x, y in spans]
                at = np.unique(np.concatenate(found))
            else:
                at = at[:positives]
            out += [(anchor, -s[j], ids[j], not second) for j in at]
        return pd.DataFrame(out, columns=["anchor_id", "falling", "row_id", "positive"]).astype({"anchor_id": "int64", "falling": "int64", "row_id": "int64", "positive": "bool"})

    return tile


def _stream(positives: int, negatives: int, low: int, high: int):
    """Of pairs in the order of their keys: a positive opens a window, which takes the first negatives that fall into it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, opened, seen, zeros = None, [], 0, []
        for pdf in batches:
            out: list[tuple] = []
            for a, falling, row, positive in zip(*(pdf[c].tolist() for c in ("anchor_id", "falling", "row_id", "positive")), strict=True):
                if a != anchor:
                    anchor, opened, seen, zeros = a, [], 0, []
                score = -falling
                if positive:
                    if seen < positives:
                        seen += 1
                        opened.append([row, score, *window(score, low, high), 0])
                        if score == 0:  # its window is 0 itself, so negatives with smaller ids came before it
                            out += [(a, row, k + 1, n, 0, 0) for k, n in enumerate(zeros)]
                            opened[-1][4] = len(zeros)
                    continue
                opened = [w for w in opened if w[4] < negatives and score >= w[2]]
                for w in opened:
                    if score <= w[3]:
                        w[4] += 1
                        out.append((a, w[0], w[4], row, w[1], score))
                if score == 0 and len(zeros) < negatives:
                    zeros.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _MINED.split(", ")])

    return run


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    anchors_per_tile: int = ANCHORS, rows_per_tile: int = ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    Components become floor(scale * x); scores are integer inner products, exact. An anchor's positives are its first rows of
    the same label by (score descending, id). For each of them, the first negatives in that order are returned whose
    100 * score lies between low and high times the positive's score (low and high not negative, high at most 100).

    The anchors, a stated set of queries, meet all rows in tiles of bounded size. A first pass over the tiles finds each
    anchor's positives; each tile pre-aggregates to the few of its rows that can be among them. In a second one each tile
    gives the first negatives of each window. What is left, some twenty pairs for each anchor and tile, is shuffled by
    anchor and sorted by (anchor, descending score, id) within partitions (repartition and sortWithinPartitions, the DataFrame
    form of that shuffle), and a streaming iterator opens positive windows and emits negatives, whatever an anchor's rows.

    Rows with a null id, a null label, or a null vector or component, or one that isn't finite, take no part; neither do
    vectors of another length than the anchor's. An empty vector scores 0. Of rows that repeat an id the one with the smallest (label, vector)
    counts. Components beyond 64 bits and scores beyond them stop at their ends. Other columns are ignored; an empty table gives no rows.
    """
    if not (0 <= low and high <= 100):
        raise ValueError("low and high must lie between 0 and 100")
    limit = float("inf")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = vectors.where("vec_id is not null and label is not null").where(finite)
    code = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), code.alias("code"), is_anchor.alias("anchor"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "code", "anchor")).alias("r")).select("vec_id", "r.*")
    rows = stash(rows.withColumn("dim", F.size("code")), "codes")
    n, many = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    high_blocks, wide_blocks = max(1, -(-many // anchors_per_tile)), max(1, -(-n // rows_per_tile))
    block = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    anchors = rows.where("anchor").select("vec_id", "label", "code", "dim")
    wide = rows.select(F.col("vec_id").alias("row_id"), F.col("label").alias("row_label"), F.col("code").alias("row_code"), F.col("dim").alias("row_dim"), block(wide_blocks, 1).alias("row_j"))
    wide = wide.withColumn("row_i", every(high_blocks))

    def tiles(anchors: DataFrame, second: bool) -> DataFrame:
        tall = anchors.withColumn("i", block(high_blocks, 2)).withColumn("j", every(wide_blocks))
        return tall.groupBy("i", "j", "dim").cogroup(wide.groupBy("row_i", "row_j", "row_dim")).applyInPandas(_tile(positives, negatives, low, high, second), _PAIR)

    best = F.slice(F.array_sort(F.collect_list(F.struct("falling", "row_id"))), 1, positives)  # of at most that many for each tile
    found = stash(tiles(anchors, False).groupBy("anchor_id").agg(best.alias("b")).select("anchor_id", F.explode("b").alias("p")).select("anchor_id", "p.falling", "p.row_id"), "positives")
    opened = found.groupBy("anchor_id").agg(F.collect_set(-F.col("falling")).alias("best"))
    pairs = tiles(anchors.join(opened, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), True)
    pairs = pairs.unionByName(found.withColumn("positive", F.lit(True)))
    ordered = pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", "falling", "row_id")
    return ordered.mapInPandas(_stream(positives, negatives, low, high), _MINED)
