"""Rules over extracted text, as Column -> Column functions. Whole texts unless a rule itself samples; nulls count as empty."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed thresholds of the quality rules.
SCANNED_CHARS_PER_PAGE, MIN_CHARS, MIN_WORDS_PER_PAGE, MIN_TEXT = 150, 500, 50, 50

#: Fixed replacements: one character each, then one to several.
ONE_TO_ONE = {"‘": "'", "’": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "•": "*", "‣": ">", "\u00a0": " ", "\u202f": " ", "\u200b": "", "\ufeff": ""}
ONE_TO_MANY = {"₹": "Rs.", "€": "EUR", "£": "GBP", "¥": "YEN", "…": "..."}

#: Fixed patterns of legacy fonts, special characters and letter pairs that mark corrupted text.
LEGACY = ["lkekftd", "iQjojh", "lans'k", "jfonkl", "U;k;", "lar", "xka/kh", "Hkkjr", "ea=ky;"]
SPECIAL, PAIRS = r"[@#$%^&*~`|\\{}\[\]]", "dk|dh|ds|nh|fk|jk|uk|vk|lk"

#: Fixed table: script -> (first, last code point, language).
SCRIPTS = {
    "devanagari": (0x0900, 0x097F, "hi"), "bengali": (0x0980, 0x09FF, "bn"), "gurmukhi": (0x0A00, 0x0A7F, "pa"), "gujarati": (0x0A80, 0x0AFF, "gu"), "odia": (0x0B00, 0x0B7F, "or"),
    "tamil": (0x0B80, 0x0BFF, "ta"), "telugu": (0x0C00, 0x0C7F, "te"), "kannada": (0x0C80, 0x0CFF, "kn"), "malayalam": (0x0D00, 0x0D7F, "ml"), "other_non_ascii": (0x0080, 0x08FF, "hi"),
}

_SPACE = r"(?U)\s+"


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """The text without blanks at either end: its first character that is none up to its last, so that not every blank within is tried as an end."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^(?U:\s)*+(.*(?U:\S))", 1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_chars(text: Column, letters: str) -> Column:
    """How many characters are of a class (in brackets); unlike count it builds no list of them."""
    return F.length(text) - F.length(F.regexp_replace(text, letters + "+", ""))


def word_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\S+", "w"), _SPACE, ""))


def lines(text: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def sanitize_text(text: Column, nfc: bool = False) -> Column:
    for old, new in ONE_TO_MANY.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    kept = {k: v for k, v in ONE_TO_ONE.items() if v}
    gone = "".join(k for k, v in ONE_TO_ONE.items() if not v)
    text = F.translate(text, "".join(kept) + gone, "".join(kept.values()))
    return F.when(text.rlike(r"\p{M}"), _nfc(text)).otherwise(text) if nfc else text


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t\r ]]", "")


def clean_text(text: Column, max_words: int = 2500) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r"\n{2,}", "\n")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")

    def cut(t: Column) -> Column:
        first = lambda words: F.when(F.size(words) > max_words, F.array_join(F.slice(words, 1, max_words), " ")).otherwise(t)
        # So many words and a blank between any two of them need a longer text.
        return F.when(F.length(t) <= 2 * max_words, t).otherwise(bind(F.filter(F.split(t, _SPACE), lambda w: w != ""), first))

    return strip(bind(text, cut))


def has_sufficient_text(text: Column) -> Column:
    return F.length(strip(text)) >= MIN_TEXT


def title_from_text(text: Column) -> Column:
    fits = F.filter(F.slice(lines(text), 1, 5), lambda x: (F.length(x) >= 10) & (F.length(x) <= 100))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit("Untitled Document"))


def title_from_metadata(title: Column, heading: Column, text: Column) -> Column:
    """A title that says something, else a heading of 10 to 100 characters, else from the text."""
    title, heading = strip(title), strip(heading)
    idle = F.lower(title).isin("", "untitled", "document", "untitled document", "microsoft word")
    return F.when(~idle, title).when(F.length(heading).between(10, 100), heading).otherwise(title_from_text(text))


def latin_extended_ratio(text: Column) -> Column:
    return bind(strip(text), lambda t: F.coalesce(F.try_divide(count_chars(t, r"[\u00A0-\u024F]"), F.length(t)), F.lit(0.0)))


def assess_quality(text: Column, pages: Column, confidence: Column) -> Column:
    """struct(text_density, is_scanned, quality_tier, recommended_engine, ocr_confidence); confidence 0 is reported as null."""
    density = F.coalesce(F.try_divide(F.length(strip(text)), pages), F.lit(0.0))
    scanned = density < SCANNED_CHARS_PER_PAGE
    tier = F.when(~scanned, "high").when(confidence.isNull(), "medium").when(confidence >= 80, "high").when(confidence >= 60, "medium").otherwise("low")
    engine = F.when(~scanned, "pymupdf").when(confidence.isNull() | (confidence >= 60), "tesseract").otherwise("easyocr")
    return F.struct(F.round(density, 2).alias("text_density"), scanned.alias("is_scanned"), tier.alias("quality_tier"), engine.alias("recommended_engine"), F.nullif(confidence, F.lit(0.0)).alias("ocr_confidence"))


def ocr_reason(text: Column, pages: Column) -> Column:
    """Why recognition should be attempted, the first rule that holds; `sufficient` if none."""
    measures = lambda t: F.struct(F.length(t).alias("n"), lines(t).alias("rows"), F.coalesce(F.try_divide(word_count(t), pages), F.lit(0.0)).alias("words"))

    def sparse(m: Column) -> Column:
        share = F.coalesce(F.try_divide(F.size(F.filter(m["rows"], lambda x: F.length(x) >= 40)), F.size(m["rows"])), F.lit(0.0))
        return F.when(F.size(m["rows"]) == 0, "no text lines").when((m["words"] < MIN_WORDS_PER_PAGE) & (share < 0.3), "sparse content").when(m["words"] < 30, "very low word density").otherwise("sufficient")

    def reason(t: Column) -> Column:
        n = F.length(t)
        extended = F.coalesce(F.try_divide(count_chars(t, r"[\u00A0-\u024F]"), n), F.lit(0.0))
        return (
            F.when(n < 200, "very little text").when(extended > 0.25, "garbled encoding").when(F.coalesce(F.try_divide(n, pages), F.lit(0.0)) < SCANNED_CHARS_PER_PAGE, "low density")
            .when(n < MIN_CHARS, "below content minimum").otherwise(bind(measures(t), sparse))
        )

    return bind(strip(text), reason)


def is_gibberish(text: Column) -> Column:
    """Of the first 1000 characters: few vowels, long consonant runs, or few tokens with a vowel; other scripts: few letters."""

    def latin(low: Column) -> Column:
        plain, words, tokens = count_chars(low, "[a-z]"), word_count(low), F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))
        few = lambda t: (F.size(t) > 20) & (F.try_divide(F.size(F.filter(t, lambda x: x.rlike("[aeiou]"))), F.size(t)) < 0.60)
        vowels = (plain > 50) & (F.try_divide(count_chars(low, "[aeiou]"), plain) < 0.20)
        runs = (words > 20) & (F.try_divide(count(low, "[bcdfghjklmnpqrstvwxyz]{4,}"), words) > 0.15)
        return vowels | runs | bind(tokens, few)

    def judged(s: Column) -> Column:
        solid = count_chars(s, r"(?U)\S")
        other = (solid > 50) & (F.try_divide(count_chars(s, r"\p{L}"), solid) < 0.30)
        return F.when(count_chars(s, r"[\p{L}&&[^\u0000-\u024F]]") > count_chars(s, "[A-Za-z]"), other).otherwise(bind(F.lower(s), latin))

    return F.coalesce(F.when(F.length(text) < 20, False).otherwise(bind(F.substring(text, 1, 1000), judged)), F.lit(False))


def is_corrupted(text: Column, legacy: list[str] = LEGACY) -> Column:

    def judged(s: Column) -> Column:
        found = F.lit(False)
        for pattern in legacy:
            found = found | s.contains(pattern)
        return found | F.coalesce((F.try_divide(count_chars(s, SPECIAL), F.length(s)) > 0.05) | (F.try_divide(count(s, PAIRS), F.length(s)) > 0.02), F.lit(False))

    return F.coalesce(F.when(F.length(text) < 50, False).otherwise(bind(F.substring(text, 1, 1000), judged)), F.lit(False))


def _by_script(text: Column, body) -> Column:
    """body(counts of each script), counted in what is left of the text without ASCII."""
    counted = lambda t: F.array(*[count_chars(t, f"[\\x{{{a:x}}}-\\x{{{b:x}}}]") for a, b, _ in SCRIPTS.values()])
    return bind(bind(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x7F]+", ""), counted), body)


def script_histogram(text: Column) -> Column:
    names = F.array(*[F.lit(name) for name in SCRIPTS])
    return _by_script(text, lambda n: F.map_filter(F.map_from_arrays(names, n), lambda k, v: v > 0))


def language_by_script(text: Column) -> Column:
    """The language of the script with most characters, the first declared on ties; hi for none or short texts."""
    languages = F.array(*[F.lit(language) for _, _, language in SCRIPTS.values()])
    best = lambda n: bind(F.array_max(n), lambda m: F.when(m > 0, F.element_at(languages, F.array_position(n, m).cast("int"))).otherwise("hi"))
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 20, "hi").otherwise(_by_script(text, best))


def text_preview(text: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def content_preview(text: Column, limit: int = 15000, window: int = 4000) -> Column:
    """The text, or of a long one its headings, start, middle, end and key lines."""
    body = strip(text)
    n = F.length(body)
    squeeze = lambda c: strip(F.regexp_replace(c, _SPACE, " "))
    heads = F.regexp_extract_all(F.substring(body, 1, 5000), F.lit(r"(?i)(?:^|\n)(?U:\s*)(?:[s\u017F]ub(?:ject)?|re|ref|regarding|विषय)[\t\n\f\r ]*[:.\-][\t\n\f\r ]*[^\n]+"), F.lit(0))
    heads = F.slice(F.filter(F.transform(heads, squeeze), lambda x: (F.length(x) > 10) & (F.length(x) < 300)), 1, 3)
    # Bounds and case are those of ASCII words, with the two other characters that fold to ASCII letters: \b would take é for a letter.
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    signal = rf"{edge}(?:(?:19|20)\d{{2}}(?:[-/]\d{{2,4}})?|[A-Za-z\u017F\u212A]{{2,}}(?:[-/][A-Za-z0-9\u017F\u212A]{{2,}})*){edge}"  # the words of the law are covered by the second part
    keys = F.slice(F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), squeeze), lambda x: F.length(x).between(35, 220) & x.rlike(signal)), 1, 10)
    middle = F.greatest(F.lit(0), F.floor(n / 2) - window // 2).cast("int")
    whole = F.concat(
        F.when(F.size(heads) > 0, F.concat(F.lit("[SUBJECT/HEADING]\n"), F.array_join(heads, "\n"), F.lit("\n\n"))).otherwise(""),
        F.lit("[START]\n"), F.substring(body, 1, window), F.lit("\n\n[MIDDLE]\n"), F.substring(body, middle + 1, F.lit(window)), F.lit("\n\n[END]\n"), F.substring(body, -window, window),
        F.when(F.size(keys) > 0, F.concat(F.lit("\n\n[KEY LINES]\n- "), F.array_join(keys, "\n- "))).otherwise(""),
    )
    cut = F.concat(F.regexp_replace(F.substring(whole, 1, limit), r"(?U)\s+$", ""), F.lit("\n...[truncated]"))
    return F.when(n <= limit, body).otherwise(F.when(F.length(whole) > limit, cut).otherwise(whole))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags as line breaks, common entities resolved, then cleaned."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "<[^>]*>", "\n")
    for entity, c in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}.items():
        t = F.replace(t, F.lit(entity), F.lit(c))
    return clean_text(F.regexp_replace(t, r"[ \t]*\n[ \t\n]*", "\n"))
