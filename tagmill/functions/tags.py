"""Rules over tags and model answers, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.functions.text import bind, strip

#: Fixed lists of the noise rules.
NOISE = ["contact", "email", "phone", "address", "document", "information", "data", "details", "pdf", "report", "government", "india", "language", "publication", "contact details", "contact information", "phone number", "email address"]
ROMAN = "(?i)^m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
MONTH = "(?i)^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
UNSUPPORTED = ["deepseek-r1", "deepseek-reasoner", "o1-", "qwen-vl", "qwen-2.5-vl"]
TIERS = ["names", "subjects", "actions", "context"]


def phrase_to_tag(phrase: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(F.lower(phrase), r"[^a-z0-9\s\-/]", " "), "/-", "  "), r"\s+", " "))


def normalize_tag(raw: Column) -> Column:
    t = F.regexp_replace(strip(F.lower(raw)), r"^[\d.\-)\]\s]+", "")
    t = F.regexp_replace(t, r"^(st|nd|rd|th)(?![\p{L}\p{N}_])\s*", "")
    t = F.translate(F.regexp_replace(t, r"[^\p{L}\p{N}_\s\-]", ""), "-", " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def is_gibberish_tag(tag: Column) -> Column:
    def bad(part: Column) -> Column:
        letters = F.regexp_count(part, F.lit("[A-Za-z]"))
        few = F.try_divide(F.regexp_count(part, F.lit("(?i)[aeiouy]")), letters) < 0.08
        return (letters >= 7) & (few | part.rlike("(?i)[bcdfghjklmnpqrstvwxz]{6,}") | part.rlike("(?i)[bcdfghjklmnpqrstvwxyz]{7,}"))

    return (F.length(tag) >= 3) & F.exists(F.split(tag, r"[\s\-]+"), bad)


def tag_verdict(tag: Column) -> Column:
    """Why a normalised tag is dropped, or `valid`."""
    def verdict(t: Column) -> Column:
        words = F.filter(F.split(t, " "), lambda w: w != "")
        return (
            F.when(t.isNull() | ~F.length(t).between(2, 80), "length").when(t.rlike("[^\\x00-\\x7F]"), "non_ascii")
            .when(F.forall(words, lambda w: w.rlike(r"^\d+$") | w.rlike(MONTH)), "date_only").when(F.size(words) > 7, "too_long")
            .when(t.rlike(ROMAN), "roman").when(is_gibberish_tag(t), "gibberish").when(t.isin(*NOISE), "generic").otherwise("valid")
        )

    return bind(tag, verdict)  # a filter by it would else normalise the tag anew for every rule


def _lists(body: Column, json: Column) -> Column:
    """The lists of a body, which json is parsed from, with their items as strings; those that hold nothing but strings are read from here."""
    return F.when(json.isNotNull(), F.from_json(body, "map<string,array<string>>"))


def _strings(json: Column, lists: Column, key: Column) -> Column:
    """The strings of the list at a key, which may leave nulls among them. A list of nothing but strings is taken from _lists, any other item by item."""
    path = F.concat(F.lit("$['"), key, F.lit("']"))
    items = F.coalesce(F.try_variant_get(json, path, "array<variant>"), F.array().cast("array<variant>"))
    mixed = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    whole = F.coalesce(F.try_element_at(lists, key), F.try_variant_get(json, path, "array<string>"))  # casting each item of a variant takes far longer
    return F.when(F.schema_of_variant(F.try_variant_get(json, path, "variant")) == "ARRAY<STRING>", whole).otherwise(mixed)


def parse_tag_response(text: Column) -> Column:
    """Raw tags of a model's answer: the string items of the JSON object's tiers in order, else the text split at , ; or lines."""
    def parsed(body: Column) -> Column:
        tiers = lambda j, lists: F.concat(*[_strings(j, lists, F.lit(t)) for t in TIERS])
        strings = bind(F.regexp_extract(body, r"(?s)\{.*\}", 0), lambda o: bind(F.try_parse_json(o), lambda j: bind(_lists(o, j), lambda lists: tiers(j, lists))))
        mark = F.when(body.contains(","), ",").when(body.contains(";"), ";").otherwise("\n")
        filled = lambda x: F.filter(F.transform(x, strip), lambda s: s != "")
        return bind(filled(strings), lambda s: F.when(F.size(s) > 0, s).otherwise(filled(F.split(body, mark))))

    return bind(strip(F.regexp_replace(text, r"```(?:json)?", "")), parsed)


def entity_answer(text: Column) -> Column:
    """The JSON of a model's answer: the body of its first fence if there is one, else all of it."""
    fenced = lambda t: F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return strip(bind(text, lambda t: bind(fenced(t), lambda f: F.when(f != "", f).otherwise(t))))


def _json_error(body: Column, json: Column) -> Column:
    """What is wrong with a stripped body, which json is parsed from; no schema of all its values is made for it."""
    return F.when(json.isNull(), "JSON parse error").when(~body.startswith("{"), "Expected an object")


def entity_error(text: Column) -> Column:
    """Why an answer gives no entities; null if it does."""
    return F.when(text.isNull(), "no answer").otherwise(bind(entity_answer(text), lambda body: _json_error(body, F.try_parse_json(body))))


def entity_list(summary: Column) -> Column:
    """The flat list (class, text) of a summary, category after category."""
    return F.flatten(F.transform(F.map_entries(summary), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("class"), v.alias("text")))))


def entity_summary(text: Column) -> Column:
    """Category -> trimmed values, case-insensitively distinct keeping the first; empty categories and those that are no lists dropped. A broken answer has none."""
    def distinct(values: Column) -> Column:
        # Where case tells none apart, the distinct ones; else, sorted by lower case and place, the first of each run stays, in the order of the places.
        first = lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["low"] != x["low"]))

        def folded(kept: Column) -> Column:
            placed = F.sort_array(F.transform(kept, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("at"), v.alias("v"))))
            return F.transform(F.sort_array(F.transform(bind(placed, first), lambda x: F.struct(x["at"], x["v"].alias("v")))), lambda x: x["v"])

        kept = F.array_distinct(F.filter(F.transform(F.array_distinct(values), strip), lambda v: v != ""))  # repeated values are stripped once
        return bind(kept, lambda k: F.when(F.size(F.array_distinct(F.transform(k, F.lower))) == F.size(k), k).otherwise(folded(k)))

    def summary(body: Column, json: Column, lists: Column) -> Column:
        keys = F.coalesce(F.when(_json_error(body, json).isNull(), F.json_object_keys(body)), F.array().cast("array<string>"))
        filled = F.filter(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), distinct(_strings(json, lists, k)).alias("v"))), lambda e: F.size(e["v"]) > 0)
        return F.map_from_entries(filled)

    return bind(entity_answer(text), lambda body: bind(F.try_parse_json(body), lambda json: bind(_lists(body, json), lambda lists: summary(body, json, lists))))


def tier_targets(total: Column) -> Column:
    names = F.greatest(F.lit(1), F.bround(total * 0.5).cast("int"))
    subjects = F.greatest(F.lit(1), F.bround(total * 0.3).cast("int"))
    return F.struct(names.alias("names"), subjects.alias("subjects"), F.greatest(F.lit(1), total - names - subjects).alias("actions"))


def request_size(tags: Column, words: Column, missing: Column | None = None) -> Column:
    """How many tags to ask for: three times as many (the words never lower it); on a retry what is missing and 8 more."""
    first = F.least(tags * 3, F.greatest(tags * 3, F.floor(words / 8).cast("int")))
    return first if missing is None else F.least(missing + 8, tags * 3)


def unsupported_model(name: Column) -> Column:
    return F.lower(name).rlike("|".join(u.replace(".", r"\.") for u in UNSUPPORTED))


#: Fixed quality tiers of which a prompt warns the model.
POOR = {"low": "The text comes from a poor scan: expect wrong letters and use only what is certain.", "medium": "The text comes from a scan: correct obvious recognition errors."}


def build_prompt(title: Column, description: Column, text: Column, tags: Column, had: Column, hints: Column, instruction: str = "Give short English tags for retrieval.", language: Column | None = None, quality: Column | None = None, excluded: Column | None = None, requested: Column | None = None) -> Column:
    """The model's prompt: title, description, preview, tier targets, tags already had (15 at most), terms not to use, and entity hints (10 each).

    A language other than English asks for translation, and a poor quality tier for care. Of the entity hints, document_type isn't
    listed; its first value becomes one of the actions. The tiers follow `tags`, however many are requested.
    """
    from tagmill.functions.text import content_preview, sanitize_text

    none = F.lit(None).cast("string")
    t = tier_targets(tags)
    listed = F.map_filter(hints, lambda k, v: (k != "document_type") & (F.size(v) > 0))
    hint = F.array_join(F.transform(F.map_entries(listed), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(F.slice(e["value"], 1, 10), ", "))), "\n")
    kind = F.try_element_at(F.try_element_at(hints, F.lit("document_type")), F.lit(1))
    return F.concat_ws(
        "\n", F.lit(instruction), none if requested is None else F.format_string("Give exactly %d tags.", requested.cast("int")),
        none if language is None else F.when(language != "English", F.concat(F.lit("The document is in "), language, F.lit(": translate names and terms to English."))),
        none if quality is None else F.when(quality == "low", POOR["low"]).when(quality == "medium", POOR["medium"]),
        F.concat(F.lit("Title: "), sanitize_text(title)), F.when(strip(description) != "", F.concat(F.lit("Description: "), sanitize_text(description))),
        F.format_string("Answer as JSON with %d names, %d subjects and %d actions.", t["names"], t["subjects"], t["actions"]),
        F.when(F.size(had) > 0, F.concat(F.lit("Already have: "), F.array_join(F.slice(had, 1, 15), ", "))),
        none if excluded is None else F.when(F.size(excluded) > 0, F.concat(F.lit("Do not use: "), F.array_join(F.sort_array(excluded), ", "))),
        F.when(F.size(F.map_keys(listed)) > 0, hint), F.when((F.size(F.map_keys(listed)) > 0) & kind.isNotNull(), F.concat(F.lit("One of the actions is the document's type: "), kind)), content_preview(sanitize_text(text)),
    )
