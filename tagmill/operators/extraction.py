"""From pages and engines to one text per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.functions.text import is_gibberish, language_by_script, strip

#: Fixed table: language -> name, recognition codes, script.
LANGUAGES = [
    ("hi", "Hindi", "hin+eng", "Devanagari"), ("kn", "Kannada", "kan+eng", "Kannada"), ("ta", "Tamil", "tam+eng", "Tamil"), ("te", "Telugu", "tel+eng", "Telugu"), ("bn", "Bengali", "ben+eng", "Bengali"),
    ("gu", "Gujarati", "guj+eng", "Gujarati"), ("ml", "Malayalam", "mal+eng", "Malayalam"), ("mr", "Marathi", "mar+eng", "Devanagari"), ("pa", "Punjabi", "pan+eng", "Gurmukhi"), ("or", "Odia", "ori+eng", "Odia"),
    ("as", "Assamese", "asm+eng", "Bengali"), ("ur", "Urdu", "urd+eng", "Arabic"), ("sa", "Sanskrit", "san+eng", "Devanagari"), ("ne", "Nepali", "nep+eng", "Devanagari"), ("en", "English", "eng", "Latin"),
]


def assemble_text(pages: DataFrame, num_pages: int) -> DataFrame:
    """(doc_id, text, pages_extracted, image_only_pages) of the first pages in order; blank pages count but add nothing."""
    kept = pages.where(F.col("page_no") <= num_pages).withColumn("blank", strip(F.col("text")) == "")
    ordered = F.array_sort(F.collect_list(F.when(~F.col("blank"), F.struct("page_no", "text"))))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("text"), F.count(F.lit(1)).alias("pages_extracted"), F.count_if("blank").alias("image_only_pages"))


def document_confidence(words: DataFrame) -> DataFrame:
    """Mean over pages of the mean of word confidences above 0, to 2 places; 0 without any."""
    page = words.groupBy("doc_id", "page_no").agg(F.avg(F.when(F.col("conf") > 0, F.col("conf"))).alias("conf"))
    return page.groupBy("doc_id").agg(F.round(F.coalesce(F.avg("conf"), F.lit(0.0)), 2).alias("confidence"))


def select_best(candidates: DataFrame) -> DataFrame:
    """(doc_id, engine, text) chosen among rows (doc_id, engine, text, confidence) of embedded, tesseract, easyocr; of an engine's repeated rows the surest, then longest."""
    wide = candidates.groupBy("doc_id").pivot("engine", ["embedded", "tesseract", "easyocr"]).agg(F.max_by(F.struct("text", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1.0)), F.length(F.coalesce("text", F.lit(""))), "text")))
    size = {e: F.length(F.coalesce(F.col(f"{e}.text"), F.lit(""))) for e in ("embedded", "tesseract", "easyocr")}
    conf = F.coalesce(F.col("tesseract.confidence"), F.lit(0.0))
    bad = {e: (size[e] > 100) & is_gibberish(F.col(f"{e}.text")) for e in ("tesseract", "easyocr")}
    good = (conf >= 60) & (size["tesseract"] > 100) & ~bad["tesseract"]
    share = F.when(conf < 60, 0.5).otherwise(0.8)
    easy = F.when(size["tesseract"] == 0, size["easyocr"] > 0).when(bad["tesseract"], ~bad["easyocr"] & (size["easyocr"] > 0) | (size["easyocr"] > size["tesseract"])).otherwise((size["easyocr"] > 0) & (size["easyocr"] >= size["tesseract"] * share))
    best = F.when(good, "tesseract").when(easy, "easyocr").when(size["tesseract"] > 0, "tesseract")
    length = F.when(best == "tesseract", size["tesseract"]).when(best == "easyocr", size["easyocr"]).otherwise(0)
    engine = F.when(length >= size["embedded"], F.coalesce(best, F.lit("embedded"))).otherwise("embedded")
    return wide.select("doc_id", engine.alias("engine"), F.when(engine == "tesseract", F.col("tesseract.text")).when(engine == "easyocr", F.col("easyocr.text")).otherwise(F.coalesce("embedded.text", F.lit(""))).alias("text"))


def route_language(docs: DataFrame, detected: str = "lang") -> DataFrame:
    """The detected language if it is known, else the script's; its name, codes and script by a broadcast of the 15 rows."""
    table = docs.sparkSession.createDataFrame(LANGUAGES, "language string, name string, codes string, script string")
    known = F.col(detected).isin(*[r[0] for r in LANGUAGES])
    short = F.length(strip(F.col("text"))) <= 20
    method = F.when(short, "image").when(known, "detected").otherwise("script")
    language = F.when(~short & known, F.col(detected)).otherwise(language_by_script(F.col("text")))
    return docs.withColumn("language", language).withColumn("method", method).join(F.broadcast(table), "language", "left")


def detect_language(docs: DataFrame, make_detector: Callable[[], Callable[[str], str]], default: str = "hi") -> DataFrame:
    """docs with `lang` by a user's detector, made once per task, on the first 1000 characters; the default for fewer than 20, or where it fails."""

    @F.pandas_udf("string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = make_detector()

        def one(text: str | None) -> str:
            try:
                return detector(text) if text and len(text.strip()) >= 20 else default
            except Exception:  # a detector may give up on a text
                return default

        for texts in batches:
            yield texts.map(one)

    return docs.withColumn("lang", detect(F.substring("text", 1, 1000)))
