"""Jobs and their documents: history, statistics, search, upkeep. Orderings carry a unique key, so limits are defined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.operators.shared import keep


def visible_to(user: int | None) -> Column:
    """A user's jobs, and those of nobody."""
    return F.col("user_id").isNull() | (F.col("user_id") == user)


def filter_jobs(jobs: DataFrame, status: str = "all", job_type: str = "all") -> DataFrame:
    for name, value in (("status", status), ("job_type", job_type)):
        jobs = jobs if value == "all" else jobs.where(F.col(name) == value)
    return jobs


def count_by_status(docs: DataFrame, *keys: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "success", "failed")]
    return docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)


def job_progress(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Counters of each job recomputed from its documents; progress is the finished share."""
    counts = count_by_status(docs, "job_id")
    done = F.coalesce(F.col("success") + F.col("failed"), F.lit(0))
    total = F.coalesce("total", F.lit(0))
    joined = jobs.join(counts, jobs["id"] == counts["job_id"], "left").drop("job_id")
    return joined.select(*jobs.columns, total.alias("total_documents"), F.coalesce("success", F.lit(0)).alias("processed_count"), F.coalesce("failed", F.lit(0)).alias("failed_count"), F.coalesce(F.try_divide(done, total), F.lit(0.0)).alias("progress"))


def recent_per_user(jobs: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.desc_nulls_last("created_at"), "id")
    return jobs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def user_stats(progress: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Totals per user over all jobs, or over the newest max_jobs."""
    rows = progress if max_jobs is None else recent_per_user(progress, max_jobs)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("jobs"), F.sum("total_documents").alias("documents"), F.sum("processed_count").alias("processed"), F.sum("failed_count").alias("failed"))


def page(df: DataFrame, limit: int, offset: int = 0, key: str = "id", newest: bool = True) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    order = F.desc_nulls_last("created_at") if newest else F.asc_nulls_last("created_at")
    return df.orderBy(order, key).offset(offset).limit(limit)


def lookup_by_id(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The row of an id, or none; the filter reaches the scan."""
    return df.where(F.col(key) == value)


def count_user_jobs(jobs: DataFrame, user: int | None) -> DataFrame:
    return jobs.where(visible_to(user)).agg(F.count(F.lit(1)).alias("jobs"))


def batch_summary(docs: DataFrame, *keys: str) -> DataFrame:
    """Documents, those processed and failed, and the processed share in percent to one place."""
    counts = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.withColumn("success_rate", F.round(100 * F.col("processed") / F.greatest("total", F.lit(1)), 1))


def with_result(rows: DataFrame, docs: DataFrame, key: str, doc_key: str) -> DataFrame:
    """Rows that have any document with a result."""
    done = docs.where(F.col("status").isin("success", "failed")).select(F.col(doc_key).alias("_done")).distinct()
    return rows.join(done, F.col(key) == F.col("_done"), "left_semi")


def recent_documents(docs: DataFrame, limit: int, *keys: str) -> DataFrame:
    return docs.where(F.col("status").isin("success", "failed")).orderBy(F.desc_nulls_last("processed_at"), *keys).limit(limit)


def search(docs: DataFrame, query: str, limit: int, *keys: str, raw_pattern: bool = False) -> DataFrame:
    """Documents whose title or a tag contains the query, whatever its case; wildcards only with raw_pattern."""
    q = query if raw_pattern else query.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    hit = F.col("title").ilike(f"%{q}%") | F.exists("tags", lambda t: t.ilike(f"%{q}%"))
    return docs.where(hit).orderBy(F.desc_nulls_last("processed_at"), *keys).limit(limit)


def job_detail(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    return jobs.join(docs.drop("status"), jobs["id"] == docs["job_id"], "left").drop("job_id")


def delete_cascade(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    return docs.join(deleted.select(F.col("id").alias("job_id")).distinct(), "job_id", "left_anti")


def forget_users(jobs: DataFrame, users: DataFrame) -> DataFrame:
    gone = users.select("user_id", F.lit(True).alias("_gone")).distinct()
    return jobs.join(gone, "user_id", "left").withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).drop("_gone")


def drop_cancelled(docs: DataFrame, commands: DataFrame) -> DataFrame:
    """Documents of jobs whose latest command is not `cancel`."""
    last = commands.groupBy("job_id").agg(F.max_by("command", F.struct("event_time", "event_id")).alias("command"))
    return docs.join(last.where("command = 'cancel'").select("job_id"), "job_id", "left_anti")


def running_progress(docs: DataFrame, *order: str) -> DataFrame:
    """Row number, finished share and running counts within each job."""
    w = W.partitionBy("job_id").orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.count(F.lit(1)).over(W.partitionBy("job_id"))
    return docs.select(
        "*", F.row_number().over(w).alias("row_number"), (F.row_number().over(w) / n).alias("progress"),
        F.sum((F.col("status") == "success").cast("int")).over(so_far).alias("processed_so_far"), F.sum((F.col("status") == "failed").cast("int")).over(so_far).alias("failed_so_far"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where the key agrees, the new values that are not null replace the old ones. Counters are recomputed, never added to."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, keys, "full")
    return joined.select(*keys, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in rest])


def result_table(docs: DataFrame, path: str, buckets: int = 64) -> None:
    """Write documents (with job_id and updated_at) as a table of so many buckets of jobs, which update_results changes in place."""
    docs.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def update_results(spark: SparkSession, path: str, results: DataFrame, keys: Sequence[str], now: Column, order: str | None = None, buckets: int = 64) -> None:
    """Set status, tags, extracted_text, processing_metadata and error_message of the documents that have a result, and processed_at and updated_at to now.

    results has job_id, the keys, status and any of the other columns; what it lacks or holds as null is set to null, tags to an empty
    list, as a result replaces the one before whole. Of several results for a document the last by `order` counts; those without
    a document are ignored. Only buckets of jobs with results are read and overwritten (dynamic partition overwrite);
    the files of all others stay. Counters are recomputed from the documents, never added to.
    """
    fields = [c for c in ("status", "tags", "extracted_text", "processing_metadata", "error_message") if c in spark.read.parquet(path).columns]
    ids = list(dict.fromkeys(["job_id", *keys]))
    new = results if order is None else results.groupBy(*ids).agg(F.max_by(F.struct(*[c for c in results.columns if c not in ids]), order).alias("_new")).select(*ids, "_new.*")
    new = keep(new.select(*ids, *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit")).withColumn("bucket", _bucket(buckets)), "results")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    # Documents and results are dealt by bucket once; each document takes the result of its group there, and the groups lie as they are written.
    given = new.dropna(subset=ids).select("bucket", *[F.col(c).cast(old.schema[c].dataType) for c in ids], F.struct("_hit", *[f"_{c}" for c in fields]).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).unionByName(given, allowMissingColumns=True).repartition("bucket")
    found = F.when(F.col("_old"), F.first("_new", ignorenulls=True).over(W.partitionBy("bucket", *ids)))
    joined = both.withColumn("_new", found).where("_old").select(*old.columns, "_new.*")
    value = lambda c: F.coalesce("_tags", F.array().cast(old.schema["tags"].dataType)) if c == "tags" else F.col(f"_{c}").cast(old.schema[c].dataType)
    cells = {c: F.when(F.col("_hit"), value(c)).otherwise(F.col(c)) for c in fields}
    cells |= {c: F.when(F.col("_hit"), now.cast(old.schema[c].dataType)).otherwise(F.col(c)) for c in ("processed_at", "updated_at") if c in old.columns}
    changed = joined.withColumns(cells).select(*old.columns)
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def purge_expired(table: DataFrame, now: Column, count: Observation | None = None) -> DataFrame:
    """The rows that neither expired before now nor were revoked. An Observation gets `removed`, how many went, with the action that computes the rest."""
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False)) | F.col("revoked_at").isNotNull()
    return (table if count is None else table.observe(count, F.count_if(gone).alias("removed"))).where(~gone)


def purge_table(spark: SparkSession, path: str, target: str, now: Column) -> int:
    """Write what purge_expired keeps of the table at path to target, and return how many rows went, from the same pass."""
    count = Observation("purge")
    purge_expired(spark.read.parquet(path), now, count).write.mode("overwrite").parquet(target)
    return count.get["removed"]


def duration_seconds(start: str, end: str) -> Column:
    return F.round((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6, 2)
