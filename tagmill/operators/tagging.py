"""Tags of documents: candidates, noise rules, exclusion lists, first occurrences, the whole flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.functions.tags import normalize_tag, tag_verdict
from tagmill.functions.text import MIN_TEXT, SCANNED_CHARS_PER_PAGE, assess_quality, bind, clean_text, has_sufficient_text, is_gibberish, strip
from tagmill.operators.shared import keep

#: An exclusion list up to so many terms becomes a filter; up to so many it may be broadcast; beyond, the join shuffles.
FILTER_TERMS, BROADCAST_TERMS = 2_000, 100_000
#: A word is hot, so that its document count is broadcast, in at least so many documents and one of so many.
HOT_LEAST, HOT_SHARE = 1_000, 1_000


def hyphenated(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), " ", "-")


def covered_grams(tag: Column) -> Column:
    """The hyphen-bounded runs of a tag's parts that cover at least half of its non-empty parts; shorter runs are not made."""
    filled = lambda parts: F.size(F.filter(parts, lambda p: p != ""))

    def runs(x: Column) -> Column:
        least = F.greatest(F.lit(1), F.ceil(x["full"] / 2).cast("int"))
        n = F.size(x["parts"])
        ends = lambda i: F.when(i + least - 1 <= n, F.sequence(i + least - 1, n)).otherwise(F.array().cast("array<int>"))
        every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(ends(i), lambda j: F.slice(x["parts"], i, j - i + 1))))
        return F.transform(F.filter(every, lambda r: (filled(r) * 2 >= x["full"]) & (filled(r) > 0)), lambda r: F.array_join(r, "-"))

    split = bind(F.split(tag, "-"), lambda p: F.struct(p.alias("parts"), filled(p).alias("full")))
    return F.array_distinct(F.concat(F.array(tag), bind(split, runs)))


def exclude_tags(tags: DataFrame, terms: DataFrame, column: str = "tag") -> DataFrame:
    """Drop tags that equal a term, or hold one on word boundaries that covers at least half of their words.

    Each tag's word runs are looked up among the terms, not all pairs tested: a short list is a set in a filter, so the tags
    pass once and nothing is shuffled; a longer one is joined with the distinct tags' runs.
    """
    short = terms.select(hyphenated(F.col("term")).alias("gram")).where("gram <> ''").limit(FILTER_TERMS + 1).collect()
    if len(short) <= FILTER_TERMS:
        # A tag holds a term only if one of its parts is the term's first; few tags do, and only theirs are put together.
        listed = sorted({t.gram for t in short})
        begun = lambda tag: F.exists(F.split(tag, "-"), lambda p: p.isin(sorted({t.split("-")[0] for t in listed})))
        dropped = lambda tag: F.when(begun(tag), F.exists(covered_grams(tag), lambda g: g.isin(listed)))
        return tags.where(~F.coalesce(bind(hyphenated(F.col(column)), dropped), F.lit(False)))
    grams = tags.select(F.col(column).alias("_tag")).distinct().withColumn("gram", F.explode(covered_grams(hyphenated(F.col("_tag")))))
    wanted = terms.select(hyphenated(F.col("term")).alias("gram")).where("gram <> ''").distinct()
    n = wanted.limit(BROADCAST_TERMS + 1).count()
    hit = grams.join(F.broadcast(wanted) if n <= BROADCAST_TERMS else wanted, "gram", "left_semi").select("_tag").distinct()
    return tags.join(hit, F.col(column) == F.col("_tag"), "left_anti")


def read_exclusions(lines: DataFrame, comment_mode: str = "line") -> DataFrame:
    """Distinct lower-case terms of lines (value). A comment is a line starting with #, or with comment_mode `part` each part doing so."""
    rows = lines.select(F.trim("value").alias("value"))
    if comment_mode == "line":
        rows = rows.where(~F.col("value").startswith("#"))
    parts = rows.select(F.explode(F.split("value", ",")).alias("term")).select(F.lower(F.trim("term")).alias("term"))
    return parts.where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def first_occurrence(tags: DataFrame, key: str, *order: str, column: str = "tag") -> DataFrame:
    """The first of tags that agree but for case and outer blanks, per key."""
    w = W.partitionBy(key, F.lower(F.trim(column))).orderBy(*order)
    return tags.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_in(tags: Column) -> Column:
    """first_occurrence of an array of tags, as an array of (pos, tag) in order: a row that holds all tags of a key needs no shuffle."""
    placed = F.sort_array(F.transform(tags, lambda t, i: F.struct(F.lower(F.trim(t)).alias("low"), i.alias("pos"), t.alias("tag"))))
    first = bind(placed, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["low"] != x["low"])))
    return F.sort_array(F.transform(first, lambda x: F.struct(x["pos"], x["tag"])))


def top_tags(tags: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    return tags.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def new_tags_only(tags: DataFrame, had: DataFrame, key: str) -> DataFrame:
    low = had.select(F.col(key), F.lower("tag").alias("_low")).distinct()
    return tags.withColumn("_low", F.lower("tag")).join(low, [key, "_low"], "left_anti").drop("_low")


def _tallied(words: Column) -> Column:
    """Distinct words with their counts, an array of (tag, tf): runs of equal words, once sorted."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))).otherwise(F.array().cast("array<int>"))
        return bind(starts, lambda s: F.transform(s, lambda p, k: F.struct(F.get(w, p - 1).alias("tag"), (F.coalesce(F.get(s, k + 1), F.size(w) + 1) - p).cast("long").alias("tf"))))

    return bind(F.sort_array(words), runs)


def _counted(text: Column) -> Column:
    return _tallied(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))


def _phrases(text: Column, longest: int) -> Column:
    """Words and phrases of a text with their counts: phrases stand in one piece, occur twice at least, and neither begin nor end with
    a short word. What a longer one holds as often is left out."""

    def runs(words: Column, k: int) -> Column:
        """The runs of k words, if there are more words."""
        every = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) > k, every).otherwise(F.array().cast("array<string>"))

    # Of k words from each long word on: looked for ahead of it, so that phrases may overlap, and ending where their last word does.
    ahead = lambda k: "(?=([a-z]{4,}+" + " [a-z]++" * (k - 2) + " [a-z]{4,}+))[a-z]++"
    grams = lambda t: F.concat(F.regexp_extract_all(t, F.lit("[a-z]{4,}"), F.lit(0)), *[F.regexp_extract_all(t, F.lit(ahead(k)), F.lit(1)) for k in range(2, longest + 1)])
    tallied = bind(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), " {2,}", " "), lambda t: _tallied(grams(t)))
    kept = F.filter(tallied, lambda x: (x["tf"] > 1) | ~x["tag"].contains(" "))

    def held(x: Column) -> Column:
        return F.transform(bind(F.split(x["tag"], " "), lambda w: F.concat(*[runs(w, k) for k in range(1, longest)])), lambda t: F.struct(t.alias("tag"), F.lit(0).alias("own"), x["tf"].alias("tf")))

    def maximal(own: Column) -> Column:
        # Sorted, a gram's own entry follows those of the longer ones that hold it, the most frequent of them last.
        inside = F.flatten(F.transform(F.filter(own, lambda x: x["tag"].contains(" ")), held))
        merged = F.sort_array(F.concat(inside, F.transform(own, lambda x: F.struct(x["tag"].alias("tag"), F.lit(1).alias("own"), x["tf"].alias("tf")))))
        covered = lambda m, x, i: (F.get(m, i - 1)["tag"] == x["tag"]) & (F.get(m, i - 1)["tf"] >= x["tf"])
        left = lambda m: F.filter(m, lambda x, i: (x["own"] == 1) & ~F.coalesce((i > 0) & covered(m, x, i), F.lit(False)))
        return F.transform(bind(merged, left), lambda x: F.struct(x["tag"].alias("tag"), x["tf"].alias("tf")))

    return bind(kept, maximal)


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, tag, tf, df, rank) of a written table (doc_id, w), w an array of (tag, tf): the first n by tf, then rarity.

    Only what may be among the first n leaves its row: those whose tf has rank n or better, ties and all. Their document counts come by
    two joins: words of one document in HOT_SHARE or more, of which there are at most HOT_SHARE times a mean document's words, are
    broadcast; of the others no word has a large share of the rows.
    """
    df = rows.select(F.explode("w").alias("w")).groupBy(F.col("w.tag").alias("tag")).agg(F.count(F.lit(1)).alias("df"))
    df = keep(df, "document-counts")
    hot = F.broadcast(df.where(F.col("df") >= max(HOT_LEAST, rows.count() // HOT_SHARE)).withColumnRenamed("df", "_hot"))
    least = F.coalesce(F.get(F.sort_array(F.transform("w", lambda x: x["tf"]), False), F.lit(n - 1)), F.lit(0))
    likely = rows.select("doc_id", F.explode(bind(least, lambda t: F.filter("w", lambda x: x["tf"] >= t))).alias("w")).select("doc_id", "w.tag", "w.tf")
    likely = likely.join(hot, "tag", "left")
    known = likely.where("_hot is not null").select("doc_id", "tag", "tf", F.col("_hot").alias("df"))
    rest = likely.where("_hot is null").drop("_hot").join(df, "tag").select("doc_id", "tag", "tf", "df")
    return top_tags(known.unionByName(rest), "doc_id", n, F.desc("tf"), F.asc("df"), "tag")


def candidate_tags(docs: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, tag, tf, df, rank): words of 4 letters or more ranked by tf, then rarity: a stand-in for a model.

    Words are counted within their row, once, and written; the texts are read only then.
    """
    return _ranked(keep(docs.select("doc_id", _counted(F.col("text")).alias("w")), "words"), n)


def candidate_phrases(docs: DataFrame, n: int = 8, longest: int = 3, min_df: int = 2) -> DataFrame:
    """(doc_id, tag, tf, df, rank): words and phrases of up to `longest` words, ranked by tf, then rarity.

    A word or phrase goes if a longer phrase of the document holds it as often. Of a document's first n, those of fewer than
    min_df documents go. Null and empty texts have none; doc_id must be unique.
    """
    return _ranked(keep(docs.select("doc_id", _phrases(F.col("text"), longest).alias("w")), "phrases"), n).where(F.col("df") >= min_df)


def tag_documents(docs: DataFrame, terms: DataFrame, n: int = 8) -> DataFrame:
    """One row per document: success, tags, error, metadata. A document without enough readable text has a stage-prefixed error.

    Each text is read, cleaned and judged once; its counted words, its length and its error are written, one row per document, and all that
    follows reads that table. metadata is null without enough text; page_count, extraction_method and ocr_confidence are
    those columns of docs where it has them.
    """
    short, odd = "Text extraction failed: insufficient text", "Text extraction failed: gibberish"
    given = {"page_count": "int", "extraction_method": "string", "ocr_confidence": "double"}
    known = {c: F.col(c).cast(t) if c in docs.columns else F.lit({"page_count": 1, "extraction_method": "text"}.get(c)).cast(t) for c, t in given.items()}
    none = F.array().cast("array<struct<tag:string,tf:bigint>>")

    def judged(text: Column) -> Column:
        error = F.when(~has_sufficient_text(text), short).when(is_gibberish(text), odd)
        return F.struct(text.alias("text"), error.alias("error"), F.length(strip(text)).alias("length"))

    def told(x: Column) -> Column:
        return F.struct(x["error"].alias("error"), x["length"].alias("length"), F.when(x["error"].isNull(), _counted(x["text"])).otherwise(none).alias("w"))

    rows = docs.select("doc_id", *[c.alias(k) for k, c in known.items()], bind(bind(clean_text(F.col("text")), judged), told).alias("x"))
    rows = keep(rows.select("doc_id", *given, "x.*"), "judged")
    found = _ranked(rows.select("doc_id", "w"), 3 * n).withColumn("tag", normalize_tag(F.col("tag")))
    found = exclude_tags(found.where(tag_verdict(F.col("tag")) == "valid"), terms)
    best = top_tags(first_occurrence(found, "doc_id", "rank"), "doc_id", n, F.desc("tf"), F.asc("df"), "tag")
    listed = best.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    out = rows.drop("w").join(listed, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    out = out.withColumn("error", F.coalesce("error", F.when(F.size("tags") == 0, "Tag generation failed: no tags")))
    scanned = F.coalesce(F.try_divide(F.col("length"), F.col("page_count")), F.lit(0.0)) < SCANNED_CHARS_PER_PAGE
    metadata = F.struct(scanned.alias("is_scanned"), "extraction_method", "ocr_confidence", "page_count", F.col("length").alias("text_length"))
    return out.select("doc_id", F.col("error").isNull().alias("success"), "tags", "error", F.when(F.col("length") >= MIN_TEXT, metadata).alias("metadata"))


def preview_tags(tags: Column, n: int) -> Column:
    """The first n tags, and how many more there are."""
    return F.struct(F.slice(tags, 1, n).alias("shown"), F.greatest(F.lit(0), F.size(tags) - n).alias("more"))


def corpus_quality(docs: DataFrame) -> DataFrame:
    """Documents, and those short, gibberish or scanned, per language."""
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~has_sufficient_text(F.col("text"))).alias("short"), F.count_if(is_gibberish(F.col("text"))).alias("gibberish"),
        F.count_if(assess_quality(F.col("text"), F.lit(1), F.lit(None).cast("double"))["is_scanned"]).alias("scanned"),
    )
