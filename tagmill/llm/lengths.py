"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.llm.common import stash

#: Where the vocabulary lies on every machine, and how it splits text (fixed values of that vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Lengths of one slice of the histogram; characters of a text that are encoded at a time.
SLICE, PIECE = 4096, 100_000
#: White space of this many characters is too long for the pattern, which would look ahead from each of them.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a long text where the splitting pattern starts a new word anyway: before a lone space within text."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def token_count(encoding, text: str) -> int:
    """The number of tokens of a whole text, however long its words and its white space.

    Of white space before a word the pattern takes all but the last character as one word, and at a text's end all of it:
    long runs are taken out by that rule, the texts between them are encoded piece by piece.
    """
    total, start = 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - 1 if run.end() < len(text) else run.end()
        total += sum(len(encoding.encode_ordinary(p)) for p in pieces(text[start : run.start()]))
        total += len(encoding._encode_single_piece(text[run.start() : end]))
        start = end
    return total + sum(len(encoding.encode_ordinary(p)) for p in pieces(text[start:]))


def encoded_length(path: str = VOCABULARY):
    """A column function: the number of tokens of each whole text; null and empty texts have none, repeated ones each their own.

    The vocabulary must lie at the path on every machine; a missing or broken one is an error before any task starts.
    """
    _encoding(path)

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for texts in batches:
            yield pd.Series([token_count(encoding, t) if t else 0 for t in texts], dtype="int64")

    return length


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From rows of (length): one row per distinct length with the sums that answer every context limit.

    n_docs and n_tokens of the length itself; docs_above and tokens_above of longer documents (suffix sums);
    share_at_most, the share of documents no longer than it; truncated_total, the tokens left when every document is cut
    to that length. Any other limit L lies between two rows: take the next smaller row s, then the truncated total
    is truncated_total(s) + (L - s) * docs_above(s); see truncated_total().

    Documents are folded to lengths before anything moves. The sums run within slices of 4096 lengths, and over the
    slices' totals, so no task holds the whole histogram. Null lengths count as 0; an empty table gives no rows.
    """
    whole = lengths.select(F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    whole = stash(whole, "histogram").withColumn("slice", F.floor(F.col("length") / SLICE)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    slices = whole.groupBy("slice").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = W.orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    slices = slices.select(
        "slice", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("tokens")
    )
    above = W.partitionBy("slice").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    joined = whole.join(slices, "slice")
    joined = joined.withColumn("docs_above", F.col("d") + F.coalesce(F.sum("n_docs").over(above), F.lit(0)))
    joined = joined.withColumn("tokens_above", F.col("t") + F.coalesce(F.sum("n_tokens").over(above), F.lit(0)))
    return joined.select(
        "length", "n_docs", "n_tokens", "docs_above", "tokens_above",
        F.round(1 - F.col("docs_above") / F.col("docs"), 6).alias("share_at_most"),
        (F.col("tokens") - F.col("tokens_above") + F.col("length") * F.col("docs_above")).alias("truncated_total"),
    )


def truncated_total(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row of limits (limit): the tokens left when every document is cut to that limit, and how many are cut.

    Limits are put among the lengths, slice by slice, so each finds the last length before it without being held against
    all; where its slice has none, that of an earlier slice stands in. Null limits are left out.
    """
    h = F.struct("length", "truncated_total", "docs_above")
    known = histogram.select(F.col("length").alias("at"), h.alias("h"))
    asked = limits.where("limit is not null").select(F.col("limit").cast("long").alias("at")).distinct().withColumn("h", F.lit(None).cast(known.schema["h"].dataType))
    rows = known.withColumn("asked", F.lit(0)).unionByName(asked.withColumn("asked", F.lit(1))).withColumn("slice", F.floor(F.col("at") / SLICE))
    slices = rows.groupBy("slice").agg(F.max_by("h", F.when(F.col("asked") == 0, F.col("at"))).alias("h"))
    earlier = slices.select("slice", F.last("h", ignorenulls=True).over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    within = F.last("h", ignorenulls=True).over(W.partitionBy("slice").orderBy("at", "asked"))
    found = rows.withColumn("within", within).where("asked = 1").join(earlier, "slice").select(F.col("at").alias("limit"), F.coalesce("within", "earlier").alias("h"))
    docs = histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).scalar()
    return found.withColumn("cut_docs", F.coalesce("h.docs_above", docs)).select("limit", (F.coalesce("h.truncated_total", F.lit(0)) + (F.col("limit") - F.coalesce("h.length", F.lit(0))) * F.col("cut_docs")).alias("tokens"), "cut_docs")


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents don't exceed."""
    docs = histogram.agg(F.sum("n_docs")).scalar()
    return histogram.where((docs - F.col("docs_above")) / docs >= q).agg(F.min("length").alias("length"))


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The histogram of the encoded lengths of the whole texts of docs.

    Null and empty texts have length 0; repeated rows count each; very long texts, words and white space are counted whole.
    Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    return length_histogram(docs.select(encoded_length(path)("text").alias("length")))
