"""Sources, durable writes, models and streams: behaviour that a query's rows don't show."""

import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tagmill.functions import text
from tagmill.operators import inference, jobs, manifest, shared, tagging
from tagmill.sources import files
from tagmill.streaming import progress

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_every_replacement(spark):
    """The fixed list of replacements, written out here once more."""
    given = "₹5 €5 £5 ¥5 $5 ‘a’ “b” „c‟ d–e—f… •g ‣h i​j﻿k l m n o‍p‌q"
    assert one(spark, text.sanitize_text(F.col("t")), t=given) == "Rs.5 EUR5 GBP5 YEN5 $5 'a' \"b\" \"c\" d-e-f... *g >h ijk l m n o‍p‌q"
    assert one(spark, text.sanitize_text(F.col("t"), nfc=True), t="café") == "café"


def test_manifests_are_decoded_file_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("title,file_path,file_source_type\nÄrger,/a,local\n".encode())
    (tmp_path / "b.csv").write_bytes("title,file_path,file_source_type\ncafé,/b,local\n".encode("latin-1"))
    (tmp_path / "c [1]{x}*.csv").write_bytes('file_path,title,note\n/c,"über\nzwei ""Zeilen""",n\n'.encode())
    (tmp_path / "d.csv").write_bytes(b"")
    rows = {r.file_path: r for r in files.read_manifest(spark, str(tmp_path)).collect()}
    assert {k: (r.title, r.file_source_type, r.note) for k, r in rows.items()} == {"/a": ("Ärger", "local", None), "/b": ("café", "local", None), "/c": ('über\nzwei "Zeilen"', None, "n")}
    with pytest.raises(ValueError, match="empty"):
        files.read_manifest(spark, str(tmp_path / "d.csv"))


def test_large_files_are_rows_with_an_error(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"x" * 10)
    (tmp_path / "large.pdf").write_bytes(b"x" * 3_000_000)
    stored = files.read_binary_documents(spark, str(tmp_path), 1 << 20)
    assert {r.path.rsplit("/", 1)[1]: (r.length, r.content is None) for r in stored.collect()} == {"small.pdf": (10, False), "large.pdf": (3_000_000, True)}
    rows = spark.createDataFrame([("local", f"{tmp_path}/{n}.pdf") for n in ("small", "large", "gone")], "file_source_type string, file_path string")
    found = {r.file_path.rsplit("/", 1)[1]: r.error for r in files.attach_contents(rows, stored, 1 << 20).collect()}
    assert found == {"small.pdf": None, "large.pdf": "File too large (max 1MB)", "gone.pdf": f"File not found: {tmp_path}/gone.pdf"}


def test_preset_export_adds_tags(spark):
    m = spark.createDataFrame([("t", None, ["a", "b"]), (None, "p", None)], "title string, path string, tags array<string>")
    assert [tuple(r) for r in manifest.export_with_preset(m, ["path", "title"], {"title": "Name"}).collect()] == [("", "t", "a, b"), ("p", "", "")]
    assert manifest.export_with_preset(m, ["title"], {"_tags": "Labels"}).columns == ["title", "Labels"]
    assert manifest.export_with_preset(m.drop("tags"), ["title"], {}).columns == ["title"]


def test_purge_counts_what_went(spark, tmp_path):
    rows = [(1, 5, None), (2, 15, None), (3, 15, 1), (4, None, None), (5, None, 1), (6, 5, 1)]
    table = spark.createDataFrame(rows, "id long, expires_at long, revoked_at long")
    table.write.parquet(str(tmp_path / "t"))
    assert jobs.purge_table(spark, str(tmp_path / "t"), str(tmp_path / "kept"), F.lit(10)) == 4
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [2, 4]
    count = Observation("x")
    assert jobs.purge_expired(table.where("false"), F.lit(10), count).count() == 0 and count.get["removed"] == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = spark.range(400).select(F.col("id"), (F.col("id") % 40).alias("job_id"), F.lit("pending").alias("status"), F.array(F.lit("old")).alias("tags"), F.lit("t").alias("extracted_text"), F.lit(None).cast("timestamp").alias("processed_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    jobs.result_table(docs, path, 8)
    listed = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "docs").glob("bucket=*/*.parquet")}
    before = listed()
    now = F.lit("2024-05-05 00:00:00").cast("timestamp")
    results = spark.createDataFrame([(3, 43, "success", ["a"], 1), (3, 43, "failed", None, 2), (3, 83, "success", ["b"], 1), (3, 999, "success", ["c"], 1)], "job_id long, id long, status string, tags array<string>, at int")
    jobs.update_results(spark, path, results, ["id"], now, "at", buckets=8)
    after = listed()
    touched = {p.parent for p in before.keys() ^ after.keys()}
    assert len(touched) == 1 and all(after[p] == t for p, t in before.items() if p.parent not in touched)
    rows = {r.id: r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 400 and (rows[43].status, rows[43].tags, rows[43].extracted_text) == ("failed", [], None) and (rows[83].status, rows[83].tags) == ("success", ["b"])
    assert rows[43].processed_at == rows[83].updated_at and rows[43].processed_at.year == 2024
    assert (rows[3].status, rows[3].tags, rows[3].processed_at) == ("pending", ["old"], None)
    jobs.update_results(spark, path, results.where("false"), ["id"], now, buckets=8)
    assert listed() == after


def test_tagging_reads_its_documents_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plans = []
    keep = shared.keep
    monkeypatch.setattr(tagging, "keep", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    terms = spark.createDataFrame([("the",)], "term string")
    for f in (lambda: tagging.tag_documents(docs, terms), lambda: tagging.candidate_tags(docs), lambda: tagging.candidate_phrases(docs)):
        plans.clear()
        last = f()._jdf.queryExecution().optimizedPlan().toString()
        assert sum("text#" in p for p in plans) == 1 and "text#" not in last.replace("text_length", "")


def test_hot_words_are_joined_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"common common word{'abcdefghij'[k % 10] * 3} {'rare' * (k % 3)} other other") for k in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    plain = sorted(map(tuple, tagging.candidate_tags(docs).collect()))
    monkeypatch.setattr(tagging, "HOT_LEAST", 20)
    assert sorted(map(tuple, tagging.candidate_tags(docs).collect())) == plain and {r[1] for r in plain if r[3] == 60} == {"common", "other"}


def test_phrases_hold_their_words(spark):
    docs = spark.createDataFrame([(1, "Bank of England rates. The bank of england; rates! Alone alone, bank of England"), (2, "bank of england bank of england alone"), (3, None), (4, "")], "doc_id long, text string")
    found = {(r.doc_id, r.tag): r.tf for r in tagging.candidate_phrases(docs, 8, 3, 1).collect()}
    assert found[1, "bank of england"] == 3 and found[1, "rates"] == 2 and found[1, "alone"] == 2
    assert not {(1, "bank"), (1, "england"), (1, "bank of"), (3, "bank")} & found.keys() and found[2, "alone"] == 1
    assert {r.tag for r in tagging.candidate_phrases(docs, 8, 3, 2).collect()} == {"bank of england", "alone"}


def test_prompts_hold_the_whole_sorted_list(spark, tmp_path):
    terms = spark.range(2500).select(F.concat(F.lit("Term "), F.col("id")).alias("term")).repartition(7)
    asked = tmp_path / "asked"
    asked.mkdir()

    def client():
        def call(prompt):
            (asked / str(time.time_ns())).write_text(prompt)
            return '{"names":["rail budget","kerala","grants"]}', 1

        return call

    body = "The rail budget of the state of Kerala for the coming year, with grants. " * 3
    docs = spark.createDataFrame([("a-1", "T", None, body, "English", "high", None)], "doc_id string, title string, description string, text string, language string, quality string, hints map<string,array<string>>")
    (row,) = inference.tag_texts(docs, client, terms, 3, shared.keep).collect()
    assert row.tags == ["rail budget", "kerala", "grants"] and row.doc_id == "a-1"
    prompt = next(asked.iterdir()).read_text()
    assert "Do not use: " + ", ".join(sorted(f"term {k}" for k in range(2500))) in prompt


def stream(spark, rows, schema, folder, parts):
    """A stream of given batches, one file each, in the order of their times."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


RESULT = "job_id long, event_id long, status string, ts timestamp"


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    stops = {1: True}

    def write(batch, k, path):
        progress.write_batch(batch, k, path)
        if stops.pop(k, False):
            raise RuntimeError("stopped between write and commit")

    rows = [[(1, k * 10 + j, "success", None) for j in range(5)] for k in range(3)]
    live = stream(spark, rows, RESULT, tmp_path / "in", rows)
    run = lambda: progress.append_once(live, str(tmp_path / "log"), str(tmp_path / "check"), write).awaitTermination(120)
    with pytest.raises(Exception, match="between write and commit"):
        run()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10
    run()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == log.select("event_id").distinct().count() == 15 and {r.batch for r in log.select("batch").distinct().collect()} == {0, 1, 2}


def at(hours):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def collected(live, name, mode, tmp_path):
    q = live.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return live.sparkSession.table(name).collect()


def test_state_goes_a_day_after_the_start(rocks, tmp_path):
    """A job that returns after 24 hours starts anew, though results in between did not let it rest."""
    parts = [[(1, 1, "success", at(0)), (2, 2, "failed", at(1)), (1, 3, "failed", at(10))], [(1, 4, "success", at(23.9)), (1, 5, "success", at(24)), (2, 6, "success", at(26))], [(1, 7, "failed", at(47)), (1, 8, "success", at(80))]]
    whole = rocks.createDataFrame([r for p in parts for r in p], RESULT)
    twin = {(r.job_id, r.start): tuple(r)[2:] for r in progress.live_state(whole).collect()}
    assert twin == {(1, at(0)): (3, 2, 1), (1, at(24)): (2, 1, 1), (1, at(80)): (1, 1, 0), (2, at(1)): (1, 0, 1), (2, at(26)): (1, 1, 0)}
    last = {}
    for r in collected(progress.live_state(stream(rocks, None, RESULT, tmp_path / "in", parts)), "expiring", "update", tmp_path):
        last[r.job_id, r.start] = max(last.get((r.job_id, r.start), (0,)), tuple(r)[2:])
    assert last == twin


def test_silence_is_reported_without_a_row(rocks, tmp_path):
    """Job 1 falls silent while job 2 goes on; job 3 is over; job 4 speaks in time."""
    parts = [[(1, 1, "processing", at(0)), (3, 2, "completed", at(0)), (4, 3, "processing", at(0))], [(2, 4, "processing", at(0.4)), (4, 5, "processing", at(0.4))], [(2, 6, "processing", at(0.8)), (4, 7, "processing", at(0.8))], [(2, 8, "processing", at(1.2)), (4, 9, "processing", at(1.2))], [(2, 10, "processing", at(1.3))]]
    live = stream(rocks, None, RESULT, tmp_path / "in", parts)
    found = [tuple(r) for r in collected(progress.silent_jobs(live, 3600, over=("completed",)), "silent", "append", tmp_path)]
    assert found == [(1, at(0))]
    whole = rocks.createDataFrame([r for p in parts for r in p], RESULT)
    assert [tuple(r) for r in progress.silent_jobs(whole, 3600, over=("completed",)).collect()] == found


def test_final_and_stalled_and_active_jobs_live(spark, tmp_path):
    parts = [[(1, 1, "success", at(0)), (1, 2, "failed", at(1)), (2, 3, "success", at(0)), (3, 4, "processing", at(2))], [(2, 5, "success", at(3)), (4, 6, "success", at(4))]]
    told = [[(4, "cancelled", at(5)), (1, "pause", at(5))], [(5, "failed", at(6))]]
    totals = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 9), (5, 1)], "job_id long, total long")
    command = "job_id long, command string, event_time timestamp"
    live, orders = stream(spark, None, RESULT, tmp_path / "in", parts), stream(spark, None, command, tmp_path / "commands", told)
    whole, all_told = spark.createDataFrame(sum(parts, []), RESULT), spark.createDataFrame(sum(told, []), command)
    twin = {tuple(r) for r in progress.final_jobs(whole, totals, all_told).collect()}
    assert {(r[0], r[1]) for r in twin} == {(1, "completed"), (4, "cancelled"), (5, "failed")}
    assert {tuple(r) for r in collected(progress.final_jobs(live, totals, orders), "final", "complete", tmp_path)} == twin
    now = F.lit(at(3.5)).cast("timestamp")
    for name, f in {"stalled": lambda r: progress.stalled_jobs(r, now, 3600), "active": lambda r: progress.active_jobs(progress.latest_status(r))}.items():
        assert {tuple(r) for r in collected(f(live), name, "complete", tmp_path)} == {tuple(r) for r in f(whole).collect()} != set()


def test_cancels_on_streams(spark, tmp_path):
    parts = [[(1, 1, "x", at(0)), (1, 2, "x", at(2)), (2, 3, "x", at(2))], [(1, 4, "x", at(30)), (3, 5, "x", at(3))], [(9, 6, "x", at(90))], [(9, 7, "x", at(91))]]
    told = [[(1, "cancel", at(1)), (2, "resume", at(1))], [(3, "cancel", at(5))], [(9, "cancel", at(95))], [(8, "cancel", at(96))]]
    command = "job_id long, command string, event_time timestamp"
    whole, all_told = spark.createDataFrame(sum(parts, []), RESULT), spark.createDataFrame(sum(told, []), command)
    twin = {r.event_id for r in progress.not_cancelled(whole, all_told).collect()}
    assert twin == {1, 3, 4, 5, 6, 7}
    live, orders = stream(spark, None, RESULT, tmp_path / "in", parts), stream(spark, None, command, tmp_path / "commands", told)
    found = [r.event_id for r in collected(progress.not_cancelled(live, orders), "kept", "append", tmp_path)]
    assert len(found) == len(set(found)) and set(found) == twin - {7}  # the watermark has not passed the last one
    late = {(r.job_id, r.event_id) for r in progress.late_cancels(whole, all_told).collect()}
    assert late == {(1, 1), (3, 5), (9, 6), (9, 7)}
    assert {(r.job_id, r.event_id) for r in collected(progress.late_cancels(live, orders), "late", "append", tmp_path)} == late
