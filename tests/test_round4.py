"""Queries against their SQL on odd rows."""

import duckdb
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tagmill.functions import tags, text
from tagmill.operators import jobs, tagging
from tagmill.plans.queries import QUERIES, SQL


def same(spark, tmp_path, name, **tables):
    """The query's rows on tables of (columns, rows), having checked that its SQL gives the same ones."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    key = lambda rows: sorted(rows, key=repr)
    found = key(tuple(r) for r in df.collect())
    assert found == key(con.execute("SELECT " + ", ".join(f'"{c}"' for c in df.columns) + f" FROM ({SQL[name]})").fetchall())
    return found


def texts(*rows):
    return "doc_id long, text string, lang string, source string", [(k, t, "fr", "web") for k, t in rows]


#: Long enough for a preview by parts, with lines whose ASCII words of two letters begin or end at an accented one.
EDGES = "\n".join(["è à é ù è à é ù è à é ù è à é ù è à é ù"] * 400 + ["Oiéù è à é ù è à é ù è à é ù è à é ù è à", "ùpéù è à é ù è à é ù è à é ù è à é ù è à ", "é2019é ù è à é ù è à é ù è à é ù è à é ù", "aſb ù è à é ù è à é ù è à é ù è à é ù è"])


def test_prompt_finds_key_lines_by_ascii_words(spark, tmp_path):
    assert "- Oiéù" in same(spark, tmp_path, "build_prompt", documents=texts((1, EDGES)))[0][1]


def test_preview_finds_key_lines_and_headings_by_ascii_words(spark, tmp_path):
    found = dict(same(spark, tmp_path, "content_preview", documents=texts((1, EDGES), (2, "Re: one two three four\n" + EDGES), (3, "é\nre\x0b: five six seven\n" + EDGES))))
    assert "- Oiéù" in found[1] and "- é2019é" in found[1] and "Re: one two three four\n\n[START]" in found[2] and found[3].startswith("[START]")


def test_texts_without_words_have_no_tags(spark, tmp_path):
    found = dict(same(spark, tmp_path, "parse_tag_response", documents=texts((3, "Éé 12, é."), (6, ""), (9, "one"), (12, "a, b"), (1, "é, é"), (4, "é.\n"), (15, None), (7, None))))
    assert found[3] == [] and found[9] == ["one"] and found[15] is None


def test_entities_are_listed_without_a_shuffle(spark, tmp_path):
    found = same(spark, tmp_path, "entity_list", documents=texts((1, "One two, one é TWO three"), (2, "É 1"), (3, "")))
    assert [r for r in found if r[0] == 1 and r[1] == "words"] == [(1, "words", "one", 0), (1, "words", "three", 2), (1, "words", "two", 1)]
    plan = QUERIES["entity_list"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan


def test_entity_values_of_any_kind(spark):
    answers = {
        '{"p": ["B", "a ", "b", "A", null, " "], "q": [1, "x", null, "X ", ["y"]], "r": "s", "t": [], "u": [null]}': ({"p": ["B", "a"], "q": ["x"]}, None), ' [1]': ({}, "Expected an object"), '"x"': ({}, "Expected an object"),
        "{": ({}, "JSON parse error"), ' {"p": ["　É ", "é", " "]}\n': ({"p": ["É"]}, None),
    }
    rows = spark.createDataFrame([(a,) for a in answers], "t string").select("t", tags.entity_summary(F.col("t")).alias("s"), tags.entity_error(F.col("t")).alias("e")).collect()
    assert {r.t: (r.s, r.e) for r in rows} == answers


def plan(spark, tmp_path, name):
    return QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


CASES = texts((1, "Some some SOME word Word other Kelvin Kelvin Kelvin"), (2, "none"), (3, ""), (4, "a b c"), (5, "that that that with with that"))


def test_first_occurrences_are_told_within_the_row(spark, tmp_path):
    found = same(spark, tmp_path, "first_occurrence", documents=CASES)
    assert (1, "Some", 0) in found and (1, "word", 3) in found and "Exchange" not in plan(spark, tmp_path, "first_occurrence")


def test_top_tags_are_told_within_the_row(spark, tmp_path):
    rows = texts((1, " ".join(c * 4 for c in "zyxwvutsrqzyz")), (2, "Some SOME"), (3, ""))
    assert len(same(spark, tmp_path, "top_tags", documents=rows)) == 9 and "Exchange" not in plan(spark, tmp_path, "top_tags")


def test_tags_are_paired_within_the_row(spark, tmp_path):
    part = "p_name string", [("small ring",), ("a small ring",), ("big small ring here now",), ("the",), ("rail",)]
    assert ("rail",) in same(spark, tmp_path, "exclude_tags", documents=CASES, part=part) and "Window" not in plan(spark, tmp_path, "exclude_tags")


def test_scripts_are_counted_without_ascii(spark, tmp_path):
    rows = texts(*[(k, t) for k, t in enumerate(["", "short", "plain text of more than twenty characters", "ÀÉ abc 123 ~!" * 9, "xyz " * 20] * 12)])
    assert len({r[1] for r in same(spark, tmp_path, "route_scripts", documents=rows)}) > 3
    one = spark.createDataFrame([("é" * 10 + "क" * 10,)], "t string").select(text.language_by_script(F.col("t")), text.script_histogram(F.col("t"))).first()
    assert one[0] == "hi" and one[1] == {"devanagari": 10, "other_non_ascii": 10}


def test_a_verdict_normalises_its_tag_once(spark):
    rows = spark.createDataFrame([("1) The Rail-Budget!",), ("xxi",), ("a",), (None,)], "raw string")
    tagged = rows.withColumn("tag", tags.normalize_tag(F.col("raw"))).where(tags.tag_verdict(F.col("tag")) == "valid")
    assert [r.tag for r in tagged.collect()] == ["the rail budget"]
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(raw") == 2  # for the filter, and for the column itself
    kept = tagging.exclude_tags(tagged, spark.createDataFrame([("rail",), ("budget x",)], "term string"))
    assert [r.tag for r in kept.collect()] == ["the rail budget"]


def test_answers_are_summarised_once(spark, tmp_path):
    given = texts((1, "One two, one é TWO three"), (2, "É 1"), (3, ""), (4, None))
    for name in ("entity_summary", "entity_list"):
        found = same(spark, tmp_path, name, documents=given)
        assert [r[0] for r in found if "words" in r or name == "entity_summary"] == [1] * (1 if name == "entity_summary" else 3)
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "StructsToJson" in x]


def test_lists_beside_values_of_other_kinds(spark):
    answers = {
        '{"a": ["x", "X", " y "], "b": {"c": ["z"]}, "d": ["1", null, "é"], "e": 1, "": ["w"], "f?": ["v"], "g.h": [["u"], "t"]}': {"a": ["x", "y"], "d": ["1", "é"], "": ["w"], "f?": ["v"], "g.h": ["t"]},
        '{"a": ["x"], "a": ["y"]}': {}, '{"names": ["\\u00e9\\n", "\\"q\\""]}': {"names": ["é", '"q"']},
    }
    rows = spark.createDataFrame([(a,) for a in answers], "t string").select("t", tags.entity_summary(F.col("t")).alias("s"), tags.parse_tag_response(F.col("t")).alias("p")).collect()
    assert {r.t: r.s for r in rows} == answers
    assert rows[2].p == ["é", '"q"']


def test_documents_are_dealt_once_for_their_results(spark, tmp_path, monkeypatch):
    path, plans, write = str(tmp_path / "docs"), [], DataFrameWriter.parquet
    docs = spark.createDataFrame([(1, 1, "pending"), (1, 1, "failed"), (1, None, "pending"), (2, 1, "pending"), (None, 1, "pending")], "job_id long, id long, status string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    jobs.result_table(docs.withColumn("extra", F.create_map("status", "id")), path, 4)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or write(self, *a, **b))
    results = spark.createDataFrame([(1, 1, "old", 1), (1, 1, "success", 2), (1, None, "success", 1), (None, 1, "success", 1), (2, 7, "success", 1)], "job_id long, id int, status string, at int")
    jobs.update_results(spark, path, results, ["id"], F.lit("2024-05-05").cast("timestamp"), "at", buckets=4)
    found = sorted((str(r.job_id), str(r.id), r.status, r.updated_at is not None) for r in spark.read.parquet(path).collect())
    assert found == [("1", "1", "success", True), ("1", "1", "success", True), ("1", "None", "pending", False), ("2", "1", "pending", False), ("None", "1", "pending", False)]
    assert "Join" not in plans[-1] and plans[-1].count("RepartitionByExpression") == 1
    assert spark.read.parquet(path).schema["id"].dataType.simpleString() == "bigint"


def test_phrases_are_found_by_patterns(spark, tmp_path, monkeypatch):
    plans, keep = [], tagging.keep
    monkeypatch.setattr(tagging, "keep", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    odd = "Bank  of England bank of   england, bank\tof england. Deep deep deep deep é deepé deep\ndeep abc abcd  abc abcd K\u212aing king İstanbul istanbul abcdabcd abcd abcd abcd "
    found = same(spark, tmp_path, "candidate_phrases", documents=texts((1, odd), (2, odd + odd.upper()), (3, " " + odd * 3), (4, None), (5, ""), (6, "a b c  d")))
    assert {"bank of england", "deep deep deep"} <= {r[1] for r in found}
    assert "RLIKE" not in plans[0]
