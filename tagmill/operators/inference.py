"""A user's model over partitions: one client each, failures as row values, a second attempt only where tags are missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions.tags import build_prompt, entity_error, entity_list, entity_summary, normalize_tag, parse_tag_response, request_size, tag_verdict
from tagmill.functions.text import has_sufficient_text, word_count
from tagmill.operators.tagging import exclude_tags, first_occurrence, top_tags

Model = Callable[[str], tuple[str, int]]


def apply_model(prompts: DataFrame, make_client: Callable[[], Model], workers: int | None = None) -> DataFrame:
    """(doc_id, response, tokens, error, rate_limited) of rows (doc_id, prompt); make_client runs once per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            out = []
            for key, prompt in zip(pdf["doc_id"], pdf["prompt"], strict=True):
                try:
                    response, tokens = client(prompt)
                    out.append((key, response, tokens, None, False))
                except Exception as problem:  # a failed call is a value of its row
                    text = str(problem)
                    out.append((key, None, 0, text, "429" in text or "rate" in text.lower()))
            yield pd.DataFrame(out, columns=["doc_id", "response", "tokens", "error", "rate_limited"])

    rows, key = prompts.select("doc_id", "prompt"), prompts.schema["doc_id"].dataType.simpleString()
    return (rows.repartition(workers) if workers else rows).mapInPandas(run, f"doc_id {key}, response string, tokens long, error string, rate_limited boolean")


def generate_tags(prompts: DataFrame, make_client: Callable[[], Model], terms: DataFrame, n: int, keep: Callable[[DataFrame, str], DataFrame], again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, tags, attempts, tokens, error) after at most two attempts; keep(df, name) writes a table, so no call is made twice.

    The second attempt is made for documents still short of n tags. again(rows (doc_id, had)) gives its prompts; without it
    they are the first ones. A failed call is an attempt without tags, and error is the last attempt's.
    """

    def parsed(answers: DataFrame, attempt: int) -> DataFrame:
        flat = answers.where("error is null").select("doc_id", F.posexplode(parse_tag_response(F.col("response"))).alias("pos", "raw"))
        flat = flat.select("doc_id", F.lit(attempt).alias("attempt"), "pos", normalize_tag(F.col("raw")).alias("tag"))
        return exclude_tags(flat.where(tag_verdict(F.col("tag")) == "valid"), terms)

    none = F.array().cast("array<string>")
    first = keep(apply_model(prompts, make_client), "attempt-1")
    had = first_occurrence(parsed(first, 1), "doc_id", "pos")
    listed = had.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("had"))
    short = prompts.join(listed, "doc_id", "left").withColumn("had", F.coalesce("had", none)).where(F.size("had") < n)
    second = keep(apply_model(short.select("doc_id", "prompt") if again is None else again(short.select("doc_id", "had")), make_client), "attempt-2")
    both = first_occurrence(had.unionByName(parsed(second, 2)), "doc_id", "attempt", "pos")
    best = top_tags(both, "doc_id", n, "attempt", "pos").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    calls = first.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))
    used = calls.groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum("tokens").alias("tokens"), F.max_by("error", "attempt").alias("error"))
    return used.join(best, "doc_id", "left").select("doc_id", F.coalesce("tags", none).alias("tags"), "attempts", "tokens", "error")


def tag_texts(docs: DataFrame, make_client: Callable[[], Model], terms: DataFrame, n: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(doc_id, tags, requested, returned, attempts, tokens, target_met, error) of rows (doc_id, title, description, text, language, quality, hints).

    Texts that are too short are never sent. The first prompt asks for three times as many tags; the second lists those had and asks for what is
    missing and 8 more. Every prompt holds the whole exclusion list, sorted: a scalar subquery gives it to the tasks that build prompts, of
    a size that each call of the model carries anyway.
    """
    enough = F.coalesce(has_sufficient_text(F.col("text")), F.lit(False))
    listed = terms.select(F.lower("term").alias("term")).where("term is not null").agg(F.array_sort(F.collect_set("term")).alias("words"))
    words, total = listed.scalar(), F.lit(n)

    def prompt(had: Column, requested: Column) -> Column:
        return build_prompt(F.col("title"), F.col("description"), F.col("text"), total, had, F.coalesce("hints", F.create_map().cast("map<string,array<string>>")), language=F.col("language"), quality=F.col("quality"), excluded=words, requested=requested)

    none = F.array().cast("array<string>")
    first = request_size(total, word_count(F.col("text")))
    ready = docs.where(enough)
    second = lambda short: ready.join(short, "doc_id").select("doc_id", prompt(F.col("had"), request_size(total, F.lit(0), total - F.size("had"))).alias("prompt"))
    found = generate_tags(ready.select("doc_id", prompt(none, first).alias("prompt")), make_client, terms, n, keep, second)
    out = docs.select("doc_id", F.when(enough, first).alias("requested"), F.when(~enough, "Insufficient text content for tag generation").alias("_short")).join(found, "doc_id", "left")
    tags = F.coalesce("tags", none)
    return out.select(
        "doc_id", tags.alias("tags"), F.coalesce("requested", F.lit(0)).alias("requested"), F.size(tags).alias("returned"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.size(tags) >= n).alias("target_met"), F.coalesce("_short", F.when(F.size(tags) == 0, F.coalesce("error", F.lit("no tags")))).alias("error"),
    )


def extract_entities(docs: DataFrame, make_client: Callable[[], Model], keep: Callable[[DataFrame, str], DataFrame], instruction: str = "List the named entities of the text as a JSON object of lists by category.", max_chars: int = 15000) -> DataFrame:
    """(doc_id, summary, entities, tokens, error), one row per document (doc_id, text), whether or not its call succeeds; its error never stops others.

    The model sees the first max_chars characters, which is the rule itself; texts that are too short are never sent.
    """
    enough = F.coalesce(has_sufficient_text(F.col("text")), F.lit(False))
    prompts = docs.where(enough).select("doc_id", F.concat(F.lit(instruction + "\n"), F.substring("text", 1, max_chars)).alias("prompt"))
    answers = keep(apply_model(prompts, make_client), "entities")
    answers = answers.select("doc_id", "response", "tokens", F.coalesce("error", entity_error(F.col("response"))).alias("_error"))
    out = docs.select("doc_id", enough.alias("_sent")).join(answers, "doc_id", "left")
    error = F.when(~F.col("_sent"), "Text too short for entity extraction").otherwise(F.col("_error"))
    empty = F.create_map().cast("map<string,array<string>>")
    summary = F.when(error.isNull(), entity_summary(F.col("response"))).otherwise(empty)
    return out.select("doc_id", summary.alias("summary"), F.coalesce("tokens", F.lit(0)).alias("tokens"), error.alias("error")).select("doc_id", "summary", entity_list(F.col("summary")).alias("entities"), "tokens", "error")
