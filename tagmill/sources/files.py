"""Manifests, exclusion lists and binary documents as Spark sources; every reader is lazy and takes any Hadoop path."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_BYTES = 50 * 1024 * 1024


def read_manifest(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """CSV manifests with a header; every column stays a string.

    Without an encoding each file's bytes decide: UTF-8 if they are valid, else Latin-1, which every byte fits, so one Latin-1 file
    leaves the others alone. Files are read in groups of one encoding and header, and columns that a group lacks are null.
    Empty files hold no rows; without any other it is an error.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if encoding is not None:
        return reader.option("encoding", encoding).csv(path)
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    head = F.substring_index(F.translate(F.decode("content", "ISO-8859-1"), "\r", "\n"), "\n", 1)
    groups = files.select("path", valid.alias("valid"), head.alias("head")).groupBy("valid", "head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.desc("valid"), "head").collect()
    if not groups:
        raise ValueError("The manifest is empty")
    found = []
    for g in groups:  # of few: all files of a job have a header or two
        names = next(csv.reader([g.head.encode("latin-1").decode("utf-8" if g.valid else "latin-1").removeprefix("\ufeff")]))
        names = [n if n and n not in names[:k] else f"{n}_c{k}" for k, n in enumerate(names)]
        schema = StructType([StructField(n, StringType()) for n in names])
        literal = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in g.paths]  # paths, not patterns
        found.append(reader.schema(schema).option("encoding", "UTF-8" if g.valid else "ISO-8859-1").csv(literal))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_binary_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of every file; content is null beyond the size limit, and such files are not read.

    The limit is pushed to the source on both sides.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = files.where(F.col("length") > max_bytes).select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary"))
    return files.where(F.col("length") <= max_bytes).unionByName(large)


def attach_contents(manifest: DataFrame, files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (file_source_type, file_path) with `content` of files (path, length, content), or with `error` for what can't be read.

    Paths agree without their scheme. URLs need a fetcher of the caller's: a table of what it fetched, as files like any other.
    """
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    kind = F.lower(F.trim("file_source_type"))
    found = files.select(bare(F.col("path")).alias("_path"), "length", "content")
    joined = manifest.withColumn("_at", bare(F.trim("file_path"))).join(found, F.col("_at") == F.col("_path"), "left")
    error = (
        F.when(~F.coalesce(kind, F.lit("")).isin("url", "s3", "local"), F.concat(F.lit("Unsupported source type: "), F.coalesce(kind, F.lit(""))))
        .when(F.col("_path").isNull(), F.concat(F.lit("File not found: "), F.trim("file_path")))
        .when(F.col("content").isNull() | ((kind == "local") & (F.col("length") > max_bytes)), f"File too large (max {max_bytes // (1 << 20)}MB)")
    )
    joined = joined.withColumn("error", error)
    return joined.withColumn("content", F.when(F.col("error").isNull(), F.col("content"))).drop("_at", "_path", "length")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of files under a prefix; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
