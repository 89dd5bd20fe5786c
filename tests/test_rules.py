"""Rules at their thresholds, the model flow with a fake client, sources, and streams against their batch twins."""

import re

import pytest
from pyspark.sql import functions as F

from tagmill.functions import paths, tags, text
from tagmill.operators import extraction, inference, manifest, tagging
from tagmill.sources import files
from tagmill.streaming import progress

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x



def test_text_thresholds(spark):
    words = "word " * 200
    assert [one(spark, text.has_sufficient_text(F.col("t")), t=" " + "x" * n) for n in (49, 50)] == [False, True]
    reasons = {"x" * 199: "very little text", "é" * 300: "garbled encoding", "x" * 400: "low density", "ab " * 160: "below content minimum", "x" * 999: "very low word density", words: "sufficient"}
    for t, why in reasons.items():
        assert one(spark, text.ocr_reason(F.col("t"), F.lit(1 if why != "low density" else 3)), t=t) == why
    for conf, tier in ((80.0, "high"), (60.0, "medium"), (59.99, "low")):
        assert one(spark, text.assess_quality(F.col("t"), F.lit(1), F.col("c")), t="x", c=conf).quality_tier == tier
    assert one(spark, text.assess_quality(F.col("t"), F.lit(0), F.col("c")), t="x", c=0.0).ocr_confidence is None
    assert one(spark, text.sanitize_text(F.col("t"), nfc=True), t="é ₹5 “a”…​ b") == 'é Rs.5 "a"... b'
    assert one(spark, text.strip_control(F.col("t")), t="a\x00b\u0085c\td") == "abc\td"
    assert one(spark, text.language_by_script(F.col("t")), t="ଓଡ଼ିଆ ଭାଷା ଓଡ଼ିଶାର ଭାଷା ଅଟେ") == "or" and one(spark, text.language_by_script(F.col("t")), t="नमस्ते") == "hi"
    assert one(spark, text.is_corrupted(F.col("t")), t="dk " * 40) and one(spark, text.is_gibberish(F.col("t")), t="bcdfgh " * 30)
    long = "Subject: the matter at hand\n" + ("A line of the Order of 2019 with enough words in it.\n" * 400)
    preview = one(spark, text.content_preview(F.col("t")), t=long)
    assert preview.startswith("[SUBJECT/HEADING]\nSubject: the matter at hand\n\n[START]\n") and "[KEY LINES]\n- A line of the Order" in preview


def test_tag_rules(spark):
    verdicts = {"mix": "roman", "xxi": "roman", "march 2024": "date_only", "a": "length", "café": "non_ascii", "a b c d e f g": "valid", "a b c d e f g h": "too_long", "report": "generic", "bcdfghjk": "gibberish", "rail budget": "valid"}
    for tag, verdict in verdicts.items():
        assert one(spark, tags.tag_verdict(F.col("t")), t=tag) == verdict, tag
    assert one(spark, tags.normalize_tag(F.col("t")), t=" 2nd  Rail-Budget! ") == "rail budget" and one(spark, tags.normalize_tag(F.col("t")), t="1) café x!") == "café x"
    answers = {'```json\n{"names":["A",1,null," "],"context":["C"],"subjects":["B"]}\n```': ["A", "B", "C"], "a, b;c": ["a", "b;c"], "a; b": ["a", "b"], "a\nb\n": ["a", "b"], "{broken": ["{broken"]}
    for answer, want in answers.items():
        assert one(spark, tags.parse_tag_response(F.col("t")), t=answer) == want
    assert one(spark, tags.entity_summary(F.col("t")), t='```\n{"p":["A","a "," b"],"q":[]}\n```') == {"p": ["A", "b"]}
    for n in range(3, 16):
        t = one(spark, tags.tier_targets(F.col("n").cast("int")), n=n)
        assert (t.names, t.subjects) == (max(1, round(0.5 * n)), max(1, round(0.3 * n)))
    assert one(spark, tags.unsupported_model(F.col("t")), t="x/O1-mini") and one(spark, paths.classify_error(F.col("t")), t="Rate limit") == "rate-limit"


def test_exclusions_equal_the_pattern_form(spark):
    rows = ["official languages act 1963", "social justice ministry", "rail budget", "the rail", "rail", "a b c d", "b c", "railway budget"]
    terms = ["act", "social-justice", "rail", "b c", "budget"]
    left = {r.tag for r in tagging.exclude_tags(spark.createDataFrame([(r,) for r in rows], "tag string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}

    def dropped(tag, term):
        tag, term = tag.replace(" ", "-"), term.replace(" ", "-")
        return tag == term or (re.search(rf"(?:^|-){re.escape(term)}(?:-|$)", tag) and len(term.split("-")) * 2 >= len(tag.split("-")))

    assert left == {r for r in rows if not any(dropped(r, t) for t in terms)}
    lines = spark.createDataFrame([("# a, b",), ("X, #y, z",), ("",), ("w",)], "value string")
    assert {r.term for r in tagging.read_exclusions(lines).collect()} == {"x", "z", "w"} and {r.term for r in tagging.read_exclusions(lines, "part").collect()} == {"b", "x", "z", "w"}


def test_extraction(spark):
    good = "the rain in the plain and so on " * 10
    rows = [(1, "embedded", "e", None), (1, "tesseract", good, 70.0), (2, "tesseract", "bcdfg " * 60, 90.0), (2, "easyocr", good, None), (3, "embedded", good, None), (3, "tesseract", "x", 90.0), (4, "embedded", "", None)]
    found = {r.doc_id: r.engine for r in extraction.select_best(spark.createDataFrame(rows, "doc_id long, engine string, text string, confidence double")).collect()}
    assert found == {1: "tesseract", 2: "easyocr", 3: "embedded", 4: "embedded"}


def test_manifest_and_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('title,file_source_type,file_path\n"a, b",url,http://x.org/a\nc,s3,bucket\n')
    m = manifest.require_columns(files.read_manifest(spark, str(tmp_path / "m.csv")))
    assert {r.title: r.error for r in manifest.validate_paths(m).collect()} == {"a, b": None, "c": "Invalid S3 path format"}
    with pytest.raises(ValueError, match="Missing required columns: title, file_path"):
        manifest.require_columns(m.drop("title", "file_path"))
    assert manifest.drop_columns(m, "title", "file_source_type").columns == m.columns and manifest.auto_map(["Name", "URL", "link"]) == {"title": "Name", "file_path": "link"}
    assert files.list_objects(spark, str(tmp_path)).first().size == 71 and files.read_binary_documents(spark, str(tmp_path), 10).where("content is not null").count() == 0
    files.write_csv(m, str(tmp_path / "out"))
    assert files.read_manifest(spark, str(tmp_path / "out")).count() == 2


def test_model_flow(spark, tmp_path):
    def client():
        asked = {}

        def call(prompt):
            asked[prompt] = asked.get(prompt, 0) + 1
            if prompt == "fail":
                raise RuntimeError("429 slow down")
            return ('{"names":["Rail Budget","rail budget","act"]}' if prompt == "short" else "alpha one, beta two, gamma three"), 5

        return call

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    prompts = spark.createDataFrame([(1, "short"), (2, "long"), (3, "fail")], "doc_id long, prompt string")
    out = {r.doc_id: r for r in inference.generate_tags(prompts, client, spark.createDataFrame([("act",)], "term string"), 3, keep).collect()}
    assert (out[1].tags, out[1].attempts, out[1].tokens) == (["rail budget"], 2, 10) and (out[2].tags, out[2].attempts) == (["alpha one", "beta two", "gamma three"], 1) and out[3].tags == []


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    live = progress.results(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    for k, (name, mode) in enumerate({"job_state": "complete", "latest_status": "complete", "status_windows": "complete"}.items()):
        q = getattr(progress, name)(live).writeStream.format("memory").queryName(f"live{k}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(f"live{k}").collect())) == sorted(map(str, getattr(progress, name)(progress.results(events)).collect()))
    progress.append_results(live, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()


def test_whole_model_flow(spark, tmp_path):
    """The gate, both prompts, what is requested and returned, and entities whose failure stops nothing."""
    long = "The rail budget of the state of Kerala for the coming year, with grants. " * 3
    asked = tmp_path / "asked"
    asked.mkdir()

    def client():
        def call(prompt):
            (asked / str(abs(hash(prompt)))).write_text(prompt)
            if "fails" in prompt:
                raise RuntimeError("no connection")
            if "broken" in prompt:
                return "{not json", 1
            if "entities" in prompt:
                return '```json\n{"place":["Kerala","kerala ",7],"none":[],"odd":"x"}\n```', 2
            return ('{"names":["state grants"],"subjects":["railways"]}' if "Already have" in prompt else '{"names":["rail budget","act","kerala"]}'), 5

        return call

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = [(1, "A", "d", long, "Hindi", "low", {"place": ["Kerala"], "document_type": ["order"]}), (2, "B", None, "too short", None, None, None), (3, "C", "", long + "fails", "English", "high", None), (4, "D", "", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, description string, text string, language string, quality string, hints map<string,array<string>>")
    out = {r.doc_id: r for r in inference.tag_texts(docs, client, spark.createDataFrame([("act",)], "term string"), 3, keep).collect()}
    assert (out[1].tags, out[1].requested, out[1].returned, out[1].attempts, out[1].tokens, out[1].target_met, out[1].error) == (["rail budget", "kerala", "state grants"], 9, 3, 2, 10, True, None)
    assert all((out[k].attempts, out[k].requested, out[k].error) == (0, 0, "Insufficient text content for tag generation") for k in (2, 4)) and (out[3].attempts, out[3].error, out[3].target_met) == (2, "no connection", False)
    prompts = [f.read_text() for f in asked.iterdir()]
    mine = sorted((p for p in prompts if "Title: A" in p), key=len)
    assert len(mine) == 2 and "Give exactly 9 tags." in mine[0] and "Give exactly 9 tags." in mine[1] and "Already have: rail budget, kerala" in mine[1]
    for part in ("The document is in Hindi", "poor scan", "Do not use: act", "place: Kerala", "document's type: order", "Description: d"):
        assert part in mine[0]
    assert "document_type:" not in mine[0] and not any("The document is in English" in p for p in prompts)

    texts = spark.createDataFrame([(1, long), (2, "short"), (3, long + "fails"), (4, long + "broken"), (5, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in inference.extract_entities(texts, client, keep).collect()}
    assert found[1].summary == {"place": ["Kerala"]} and [tuple(e) for e in found[1].entities] == [("place", "Kerala")] and found[1].error is None and found[1].tokens == 2
    assert [found[k].error for k in (2, 3, 4, 5)] == ["Text too short for entity extraction", "no connection", "JSON parse error", "Text too short for entity extraction"] and not found[4].summary
    assert one(spark, tags.entity_error(F.col("t")), t="[1]") == "Expected an object"


def test_manifest_reading_and_editing(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("title,file_path\ncaf\u00e9,x\n\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("title,file_path\ncaf\u00e9,x\n".encode())
    (tmp_path / "none.csv").write_text("")
    assert [r.title for n in ("latin", "utf") for r in files.read_manifest(spark, str(tmp_path / f"{n}.csv")).collect()] == ["caf\u00e9"] * 2
    with pytest.raises(ValueError, match="empty"):
        files.read_manifest(spark, str(tmp_path / "none.csv"))
    stored = files.read_binary_documents(spark, str(tmp_path))
    rows = [("local", f"{tmp_path}/utf.csv"), (" LOCAL ", f"{tmp_path}/latin.csv"), ("ftp", "x"), (None, "x"), ("s3", "s3://b/gone")]
    found = files.attach_contents(spark.createDataFrame(rows, "file_source_type string, file_path string"), stored, 28).collect()
    assert {r.file_path.split("/")[-1] + str(r.file_source_type): r.error for r in found} == {"utf.csvlocal": None, "latin.csv LOCAL ": None, "xftp": "Unsupported source type: ftp", "xNone": "Unsupported source type: ", "gones3": "File not found: s3://b/gone"}
    big = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b"))
    numbered = [r.row_number for r in manifest.number_rows(big.repartition(6), "a", "b").orderBy("a", "b").collect()]
    assert numbered == list(range(1, 20001))
    m = manifest.number_rows(files.read_manifest(spark, str(tmp_path / "utf.csv")), "title").withColumn("status", F.lit("done"))
    assert [(r.row_number, r.title, r.status) for r in manifest.append_row(m, title="new").orderBy("row_number").collect()] == [(1, "caf\u00e9", "done"), (2, "new", "pending")]
    assert manifest.rename_column(m, "title", "x").columns == m.columns and manifest.rename_column(m, "status", "x").columns[-1] == "x"
    assert manifest.export_with_preset(m, ["status", "title"], {"title": "Name"}).columns == ["status", "Name"]
    plain = spark.createDataFrame([(None, "p")], "title string, file_path string")
    assert manifest.with_defaults(plain).first().asDict() == {"title": "Untitled", "file_path": "p", "file_source_type": "url", "mime_type": "application/pdf", "status": "pending"}
    assert tuple(one(spark, paths.size_units(F.col("n")), n=1536000)) == (1500.0, 1.46)


def test_upsert_replaces_what_is_new(spark):
    from tagmill.operators import jobs

    old = spark.createDataFrame([(1, "pending", None, None, "m"), (2, "success", ["a"], "2024-01-01", "n")], "id long, status string, tags array<string>, processed_at string, metadata string")
    new = spark.createDataFrame([(1, "success", [], "2024-02-02"), (3, "failed", None, "2024-02-03")], "id long, status string, tags array<string>, processed_at string")
    rows = {r.id: tuple(r)[1:] for r in jobs.upsert(old, new, ["id"]).collect()}
    assert rows == {1: ("success", [], "2024-02-02", "m"), 2: ("success", ["a"], "2024-01-01", "n"), 3: ("failed", None, "2024-02-03", None)}


def test_detector_hook(spark):
    def make():
        def detect(text):
            if "?" in text:
                raise ValueError
            return "en"

        return detect

    rows = spark.createDataFrame([(1, "a text that is long enough"), (2, "short"), (3, "what is this long text for ?"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang for r in extraction.detect_language(rows, make).collect()} == {1: "en", 2: "hi", 3: "hi", 4: "hi"}


def test_long_exclusion_lists_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in ("official languages act 1963", "the rail", "rail", "o'hara case", "a b c d", "rail")], "tag string")
    terms = spark.createDataFrame([("rail",), ("b c",), ("o'hara",), ("back\\slash",)], "term string")
    want = sorted(r.tag for r in tagging.exclude_tags(rows, terms).collect())
    monkeypatch.setattr(tagging, "FILTER_TERMS", 1)
    assert sorted(r.tag for r in tagging.exclude_tags(rows, terms).collect()) == want == ["official languages act 1963"]


def test_more_streams_equal_their_batch_twins(spark, tmp_path):
    """Sessions, sliding windows and catching up, streamed; rows that are too late for the watermark don't occur here."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    live = progress.results(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    batch = progress.results(events)
    runs = {
        "expire": (lambda r: progress.expire_state(r), "complete"), "slide": (lambda r: progress.status_windows(r, "1 hour", "30 minutes"), "complete"),
        "caught": (lambda r: progress.catch_up(r.where("event_id % 3 > 0"), r.where("event_id % 2 = 0 OR event_id % 3 = 0")), "append"),
    }
    for name, (make, mode) in runs.items():
        make(live).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(batch).collect())), name
