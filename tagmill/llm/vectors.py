"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where the bound leaves doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import connected_components, split_join, stash

#: Bytes of one block of codes; a task compares two blocks, whose vectors are this over their length, LEAST at least.
BLOCK_BYTES, LEAST = 1 << 20, 1024
#: Allowance for the rounding of the bounds themselves; it only widens what is recomputed.
SLACK = 1e-6


def unit(z: np.ndarray) -> np.ndarray:
    z = z / np.abs(z).max(axis=1, keepdims=True)
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes (as exact float32), scales and the Euclidean error of each unit row."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None])
    return code.astype(np.float32), scale, np.linalg.norm(x - code * scale[:, None], axis=1)


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def near_pairs(x: Codes, y: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (i, j) that may have cosine >= threshold, and whether they surely have; with same, only j > i.

    For unit rows u = q + e and v = r + f, |u.v - q.r| <= |e| |v| + |q| |f| <= |e| + |f| + |e| |f|. Integer products are
    exact in float32 while 127 * 127 * dimensions < 2 ** 24; longer vectors use float64.
    """
    (p, sp, ep), (q, sq, eq) = x, y
    kind = np.float32 if p.shape[1] <= 1000 else np.float64
    p, q = p.astype(kind), q.astype(kind)
    p32, q32 = sp.astype(kind)[:, None], sq.astype(kind)[None, :]
    doubt = ep + eq.max(initial=0.0) * (1 + ep) + SLACK
    step = 512
    for a in range(0, len(p), step):
        for b in range(a if same else 0, len(q), step):
            product = p[a : a + step] @ q[b : b + step].T
            product *= p32[a : a + step]
            product *= q32[:, b : b + step]
            i, j = np.nonzero(product >= (threshold - doubt[a : a + step]).astype(kind)[:, None])
            if same and a == b:
                i, j = i[j > i], j[j > i]
            if not len(i):
                continue
            near = product[i, j].astype(np.float64)
            i, j = i + a, j + b
            bound = ep[i] + eq[j] + ep[i] * eq[j] + SLACK
            sure = near - bound >= threshold
            open_ = sure | (near + bound >= threshold)
            yield i[open_], j[open_], sure[open_]


def join_sets(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place of each place's set, once the sets of each i and j are joined; root holds it before."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low < high
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sizes = pdf["v"].map(len)
        code, scale, error = [b""] * len(pdf), np.zeros(len(pdf)), np.zeros(len(pdf))
        for d in sizes.unique():
            at = np.flatnonzero(sizes == d)
            q, scale[at], error[at] = quantise(unit(np.array(pdf["v"].iloc[at].tolist(), dtype=np.float64)))
            for k, row in zip(at, q.astype(np.int8), strict=True):
                code[k] = row.tobytes()
        yield pd.DataFrame({"rep": pdf["rep"], "n": pdf["n"], "d": sizes.astype("int32"), "code": code, "scale": scale, "error": error})


def _tile(threshold: float, exact: bool):
    """One tile's links: by codes, those that are sure, and which rows have doubtful ones; or, from vectors, the doubtful ones."""

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["t"].to_numpy() == pdf["ti"].to_numpy()
        same = bool(pdf["ti"].iloc[0] == pdf["tj"].iloc[0])
        ids, weight = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        links, doubtful, root = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool), np.arange(len(pdf))
        # Rows stand in the order of their ids, so a set's smallest place is that of its smallest id.
        order = np.argsort(ids, kind="stable")
        at = np.empty(len(ids), np.int64)
        at[order] = root
        if len(a) and len(b):
            if exact:
                u = unit(np.array(pdf["v"].tolist(), dtype=np.float64))
                code, scale, error = quantise(u)
            else:
                code = np.frombuffer(b"".join(pdf["code"]), np.int8).reshape(len(pdf), -1)
                scale, error = pdf["scale"].to_numpy(), pdf["error"].to_numpy()
            for i, j, sure in near_pairs((code[a], scale[a], error[a]), (code[b], scale[b], error[b]), threshold, same):
                if exact:
                    i, j = a[i[~sure]], b[j[~sure]]
                    hit = np.zeros(len(i), bool)
                    for k in range(0, len(i), 65536):
                        hit[k : k + 65536] = np.einsum("nd,nd->n", u[i[k : k + 65536]], u[j[k : k + 65536]]) >= threshold
                    i, j = i[hit], j[hit]
                else:
                    doubtful[a[i[~sure]]] = doubtful[b[j[~sure]]] = True
                    i, j = a[i[sure]], b[j[sure]]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = join_sets(root, at[i], at[j])
        hit = (links > 0) | doubtful
        none = np.zeros(int(hit.sum()), np.int64)
        return pd.DataFrame({"rep": ids[hit], "ti": none + pdf["ti"].iloc[0], "tj": none + pdf["tj"].iloc[0], "links": links[hit], "root": ids[order[root[at[hit]]]], "doubt": doubtful[hit]})

    return tile


def near_vectors(vectors: DataFrame, threshold: float = 0.9, block: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are folded into one representative with a count before anything is compared, so copies cost nothing.
    The representatives are dealt by hash into blocks of so many vectors (by default, of bounded bytes); the task of a pair of blocks gets their int8 codes, with each
    vector's scale and error, an eighth of the vectors' bytes. It settles the pairs that the error bound decides.
    Rows with pairs that the bound leaves open come again, tile by tile, as full vectors, and only those pairs are computed
    in double precision. A task returns a count of links and the smallest id of its set per row, over all links of
    the task, never the pairs. The work is that of all pairs of distinct vectors, cut into equal tasks; links chained
    over several tasks are joined by connected_components.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept, and so do rows without a
    vec_id. Vectors of different length don't link. Rows that repeat a vec_id are vectors of their own, that link with each
    other like any two. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("v", F.when(finite & F.col("vec_id").isNotNull(), F.col("v")))
    reps = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    reps = stash(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    count, widest, total = reps.agg(F.count(F.lit(1)), F.max(F.size("v")), F.sum("n")).first()
    blocks = max(1, -(-count // (block or max(LEAST, BLOCK_BYTES // (widest or 1)))))
    dealt_to = F.pmod(F.xxhash64("rep"), F.lit(blocks))
    codes = stash(reps.mapInPandas(_encode, "rep long, n long, d int, code binary, scale double, error double"), "codes")
    dealt = (
        codes.withColumn("t", dealt_to).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        .select("rep", "n", "d", "code", "scale", "error", "t", F.least("t", "h").alias("ti"), F.greatest("t", "h").alias("tj"))
    )
    shape = "rep long, ti long, tj long, links long, root long, doubt boolean"
    sure = stash(dealt.groupBy("d", "ti", "tj").applyInPandas(_tile(threshold, False), shape), "links")
    again = sure.where("doubt").select("rep", "ti", "tj").join(reps, "rep").withColumn("t", dealt_to).withColumn("d", F.size("v"))
    found = stash(sure.union(again.groupBy("d", "ti", "tj").applyInPandas(_tile(threshold, True), shape)).where("links > 0"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    least = reps.select("rep", "least").join(parts.withColumnRenamed("node", "rep"), "rep")
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = split_join(least.select("rep", "component"), smallest, ["component"], count).select("rep", "component_id")
    classes = reps.join(links, "rep", "left").join(named, "rep", "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = split_join(rows.where("v is not null"), classes, ["v"], total or 0).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
