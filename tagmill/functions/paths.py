"""Rules over paths, urls, names, sizes, errors and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.functions.text import strip

#: Fixed pattern of valid urls; the messages of path_error are fixed values as well.
URL = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"


def infer_source_type(path: Column, given: Column) -> Column:
    low = F.lower(strip(path))
    found = F.when(low == "", given).when(low.rlike("^https?://"), "url").when(low.startswith("s3://"), "s3").otherwise("local")
    return F.when(strip(given) != "", given).otherwise(found)


def path_error(path: Column, kind: Column) -> Column:
    """What is wrong with a path of its kind; null if nothing."""
    p, k = strip(path), F.lower(strip(kind))
    key = F.regexp_replace(p, "^s3://", "")
    return (
        F.when(p == "", "Empty path").when((k == "url") & ~p.rlike("^https?://"), "URL must start with http:// or https://")
        .when((k == "s3") & ~p.startswith("http") & ~key.rlike("^[^/]+/.+"), "Invalid S3 path format").when((k == "local") & ~p.startswith("/"), "Path must be absolute")
        .when(~k.isin("url", "s3", "local"), F.concat(F.lit("Unknown path type: "), k))
    )


def is_valid_url(url: Column) -> Column:
    return F.coalesce(strip(url).rlike(URL), F.lit(False))


def name_from_url(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    name = F.try_url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    name = F.when(F.coalesce(name, F.lit("")) == "", "URL Document").otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def s3_parts(path: Column) -> Column:
    pattern = r"^(?:s3://)?([^/]*)/?(.*)$"
    return F.struct(F.regexp_extract(path, pattern, 1).alias("bucket"), F.regexp_extract(path, pattern, 2).alias("key"))


def sanitize_filename(name: Column) -> Column:
    t = F.regexp_replace(F.translate(F.coalesce(name, F.lit("")), "/\\", "__"), '[<>:"|?*]', "")
    extension = F.regexp_extract(t, r"\.[^.]*$", 0)
    t = F.when(F.length(t) > 255, F.concat(F.substring(t, F.lit(1), 255 - F.length(extension)), extension)).otherwise(t)
    return F.when(t == "", "unnamed").otherwise(t)


def classify_error(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("429|too many requests|rate"), "rate-limit").when(m.rlike("400|bad request|developer instruction"), "model-error").when(m.rlike("connection|network|timeout"), "network").otherwise("unknown")


def file_size_error(size: Column, max_mb: int = 50) -> Column:
    return F.when(size <= 0, "File is empty").when(size > max_mb * 1024 * 1024, "File is too large")


def size_units(size: Column) -> Column:
    return F.struct(F.round(size / 1024, 1).alias("kb"), F.round(size / 1048576, 2).alias("mb"))


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def success_rate_pct(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(0).cast("long")
