"""Manifests: mapping, validation, reshaping, merging of results, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.functions.paths import infer_source_type, path_error
from tagmill.functions.text import strip
from tagmill.operators.shared import keep

REQUIRED = ("title", "file_source_type", "file_path")
PROTECTED = ("title", "file_path", "file_source_type", "description")
#: Fixed header names that map to a field.
HEADERS = {
    "title": ("title", "document_title", "doc_title", "name"),
    "file_path": ("file_path", "filepath", "path", "url", "pdf_link", "link", "pdf_url", "document_url"),
    "description": ("description", "desc", "summary"),
}


def require_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def auto_map(columns: Sequence[str]) -> dict[str, str]:
    """Field -> column; the last matching column wins."""
    return {field: c for c in columns for field, names in HEADERS.items() if c.strip().lower() in names}


def apply_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumns({field: F.col(f"`{column}`") for field, column in mapping.items()})


def normalize_rows(df: DataFrame) -> DataFrame:
    """Defaults and trims; a row without a path gets an error instead of stopping the job."""
    kind = F.lower(strip(infer_source_type(F.col("file_path"), F.col("file_source_type"))))
    return df.withColumns({
        "title": F.when(F.coalesce("title", F.lit("")) == "", "Untitled Document").otherwise(F.col("title")), "file_path": strip(F.col("file_path")),
        "file_source_type": F.when(kind.isin("url", "s3", "local"), kind).otherwise("url"), "description": strip(F.col("description")),
        "error": F.when(strip(F.col("file_path")) == "", "file_path is required"),
    })


def validate_paths(df: DataFrame) -> DataFrame:
    error = path_error(F.col("file_path"), F.col("file_source_type"))
    return df.withColumn("error", error).withColumn("valid", error.isNull())


def path_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid_count"), F.count_if(~F.col("valid")).alias("invalid_count"))


def attach_validation(df: DataFrame, results: DataFrame, order: str) -> DataFrame:
    last = results.groupBy("file_path").agg(F.max_by(F.struct("valid", "error"), order).alias("r"))
    return df.join(last, "file_path", "left").select("*", "r.*").drop("r")


def number_rows(df: DataFrame, *order: str, partition: Sequence[str] = ()) -> DataFrame:
    """Numbers from 1 by the order, which must be unique, within each partition key, or over all rows.

    Without a key, rows are dealt by ranges and sorted, numbered within their range, and written with it; numbers move on by the counts of the
    ranges before, of which there are as many as tasks. No task holds all rows, and df is computed once.
    """
    if partition:
        return df.withColumn("row_number", F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = keep(dealt.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over one row for each task
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = dealt.join(F.broadcast(starts), "_range")
    return numbered.select(*df.columns, (F.col("_at") + F.col("_start") + 1).alias("row_number"))


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*[c for c in columns if c not in PROTECTED])


def insert_column(df: DataFrame, name: str, after: str) -> DataFrame:
    at = df.columns.index(after) + 1
    return df.select(*df.columns[:at], F.lit("").alias(name), *df.columns[at:])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df if old in PROTECTED else df.withColumnRenamed(old, new)


def reorder_columns(df: DataFrame, *first: str) -> DataFrame:
    """The given columns first, the others after them in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def append_row(df: DataFrame, **values: object) -> DataFrame:
    """One more row, numbered last: pending, without a path, empty but for the given values."""
    filled = {"status": "pending", "title": "", "file_path": "", "description": ""} | values
    last = df.agg(F.coalesce(F.max("row_number"), F.lit(0)).alias("row_number"))
    cells = [(F.col("row_number") + 1 if c == "row_number" else F.lit(filled.get(c))).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    return df.unionByName(last.select(*cells))


def filter_sort(df: DataFrame, contains: Mapping[str, str] | None = None, order: Sequence[str] = (), newest: bool = False) -> DataFrame:
    """Rows whose columns contain the given texts, whatever their case, by the given columns."""
    for column, text in (contains or {}).items():
        df = df.where(F.contains(F.lower(F.col(column).cast("string")), F.lit(text.lower())))
    return df.orderBy(*[F.desc_nulls_last(c) if newest else F.asc_nulls_last(c) for c in order]) if order else df


def update_rows(df: DataFrame, ids: DataFrame, key: str, values: Mapping[str, object]) -> DataFrame:
    marked = df.join(ids.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    return marked.withColumns({c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")


def delete_rows(df: DataFrame, ids: DataFrame, key: str, *order: str) -> DataFrame:
    return number_rows(df.join(ids.select(key).distinct(), key, "left_anti"), *order)


def merge_results(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Results by row number, else by row id + 1; rows without one stay as they are."""
    new = results.select(F.coalesce(F.col("row_number"), F.col("row_id") + 1).alias("row_number"), F.when(F.col("success"), "success").otherwise("failed").alias("_status"), F.col("tags").alias("_tags"), F.col("error").alias("_error"))
    joined = manifest.join(new, "row_number", "left")
    hit = F.col("_status").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("status", "tags", "error")}).drop("_status", "_tags", "_error")


def tagged_manifest(df: DataFrame) -> DataFrame:
    status = F.when(F.col("success"), "success").otherwise(F.concat(F.lit("failed: "), F.coalesce("error", F.lit("unknown"))))
    return df.withColumn("generated_tags", F.concat_ws(", ", "tags")).withColumn("tagging_status", status)


def export_results(df: DataFrame, columns: Sequence[str], only_success: bool = False) -> DataFrame:
    rows = df.where("status = 'success'") if only_success else df
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    return rows.select(*cells, F.concat_ws(", ", "tags").alias("Generated Tags"), F.col("status").alias("Processing Status"), F.coalesce("error", F.lit("")).alias("Error"))


def export_with_preset(df: DataFrame, columns: Sequence[str], renames: Mapping[str, str]) -> DataFrame:
    """The preset's columns in its order under its names, empty where null; then the tags, if there is such a column, as `Generated Tags` or what the preset calls `_tags`."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(renames.get(c, c)) for c in columns]
    tags = [F.coalesce(F.array_join("tags", ", "), F.lit("")).alias(renames.get("_tags", "Generated Tags"))] if "tags" in df.columns else []
    return df.select(*cells, *tags)


def with_defaults(df: DataFrame) -> DataFrame:
    defaults = {"title": "Untitled", "file_path": "", "file_source_type": "url", "mime_type": "application/pdf", "status": "pending"}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
