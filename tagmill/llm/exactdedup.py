"""Exact duplicates: a 128-bit content hash, checked byte for byte, with the smallest id kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import SPACES, stash


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes agree after each run of white space became one space. Grouping by (128-bit hash,
    text) is a hash aggregate that compares the bytes of equal hashes; each task first folds its own copies into one
    row, so a group of any size reaches the shuffle as one row per task. Only ids and hashes are joined back; that join
    has no grouping above it, so a hot hash can be split. Hashes that two different texts share (none in practice) are
    joined on the bytes as well.

    Null texts count as empty; empty texts are equal to one another. Repeated rows count in group_size and carry the
    same decision. Null ids come last when choosing the smallest; an all-null group keeps a null id and its rows are kept. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id"), normalised().alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    groups = rows.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stash(groups.select("h", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")), "texts")
    shared = groups.groupBy("h").count().where("count > 1").select("h")
    slim = rows.select("doc_id", "h")
    if not shared.isEmpty():
        # Two texts under one hash: tell them apart by their bytes.
        shared = stash(shared, "shared-hashes")
        again = rows.join(shared, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        exact = rows.join(shared, "h", "left_semi").join(again, ["h", "norm"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
        rest = slim.join(shared, "h", "left_anti").join(groups.join(shared, "h", "left_anti"), "h").drop("h")
        found = rest.unionByName(exact)
    else:
        found = slim.join(groups, "h").drop("h")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one for each text, that of the smallest doc_id.

    Null, empty and blank texts: null and empty ones are equal, and one stays. Of rows that repeat both doc_id and text the one
    with the smallest hash of its columns stays (any, if those are equal), so reruns agree. An empty table gives no rows.
    """
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    kept = stash(kept, "kept")
    twice = stash(kept.groupBy("id", "sha").count().where("count > 1").drop("count"), "repeated")
    kept = kept.distinct()
    rows = docs.select(F.struct("*").alias("row"), F.sha2(normalised(), 256).alias("text_sha"))
    on = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha") == F.col("sha"))
    if twice.isEmpty():
        return rows.join(kept, on, "left_semi").select("row.*")
    single = rows.join(kept.join(twice, ["sha"], "left_anti"), on, "left_semi").select("row")
    several = rows.join(kept.join(twice, ["sha"], "left_semi"), on).groupBy("text_sha").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.unionByName(several).select("row.*")
