"""Dealt operators on urls, vectors and conversations."""

import numpy as np
from pyspark.sql import functions as F

from tagmill.llm import common, toolcalls, urls, vectors


def test_urls(spark):
    given = {
        1: ("http://a.example.net/en/1", "allow", "example.net/en/"), 2: ("http://example.net/de/1", "block", "net/"), 3: ("x", "allow", None), 4: (None, "allow", None), 5: ("", "allow", None),
        6: ("http://EXAMPLE.com/de/x?y", "block", "example.com/de/"), 7: ("http://notexample.com/de/", "allow", None), 8: ("http://b.org/fr/?q", "allow", "org/fr/"), 9: ("http://b.org?x=/fr/", "allow", None),
        10: ("http://casino-win.example.org/", "block", None), 11: ("http://casinos.example.org/", "allow", None), 12: ("http://x.org/free-bet", "block", None), 13: ("http://x.org/free/free", "allow", None), 14: ("http://net", "allow", None),
    }
    pages = spark.createDataFrame([(k, u, None, "h") for k, (u, _, _) in given.items()], "page_id long, url string, host string, verdict string")
    rows = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    for k, (_, verdict, rule) in given.items():
        assert (rows[k].verdict, rows[k].rule) == (verdict, rule), k
    assert (rows[6].host, rows[6].path, rows[3].host, rows[4].path) == ("example.com", "/de/x", "", "")
    assert (rows[13].soft_hits, rows[12].soft_hits, rows[10].strict_hits) == (1, 2, 1)
    assert urls.judge_urls(pages.where("false")).count() == 0


def test_url_weights_ties_and_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/free/deal"), (2, "http://a.org/deal/coupon/bonus"), (3, "http://a.org/gambling"), (4, "http://a.org/" + "x" * 500_000 + "/casino"), (None, "http://a.org/casino"), (6, "http://b.ab.de/xyz")], "page_id long, url string")
    rules = (("block", "de", "/xyz"), ("allow", "ab.de", "/"), ("allow", "b.de", "/"))
    rows = {r.page_id: r for r in urls.judge_urls(pages, rules=rules).collect()}
    assert [rows[k].verdict for k in (1, 2, 3, 4, None)] == ["allow", "block", "allow", "block", "block"]
    assert [rows[k].soft_weight for k in (1, 2, 3)] == [0.8, 1.0, 0.8] and (rows[6].rule, rows[6].verdict) == ("ab.de/", "allow")
    (tmp_path / "terms.csv").write_text("term,weight\nCasino,\nfree,0.5\nfree,0.7\nporn,2\nnone,0\n")
    assert urls.read_vocabulary(spark, str(tmp_path)) == (["casino", "porn"], {"free": 0.7})


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    rows = [b + rng.normal(size=24) * rng.choice([0, 0.1, 0.3, 0.45]) for b in base[rng.integers(0, 60, 400)]]
    rows += [rows[0]] * 50 + [rows[1] * 7]
    x = np.array(rows, dtype=np.float32).astype(np.float64)
    data = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    n = len(data)
    data += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [float("inf")] + [1.0] * 23), (n + 5, [None] + [1.0] * 23), (n + 6, [1.0, 2.0])]
    frame = spark.createDataFrame([(*d, "c", 1) for d in data], "vec_id long, embedding array<double>, rep string, n int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    rows = {r.vec_id: r for r in vectors.near_vectors(frame, 0.9, block=64).collect()}
    assert len(rows) == n + 7
    for i in range(n):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (linked[i].sum(), label[i], label[i] == i)
    assert all((rows[k].n_links, rows[k].component_id, rows[k].kept) == (0, k, True) for k in range(n, n + 7))
    assert vectors.near_vectors(frame.where("false")).count() == 0


def test_doubtful_pairs_and_repeated_ids(spark):
    """Cosines all around the threshold, several vectors under one id, rows without one, and a very common vector."""
    rng = np.random.default_rng(8)
    first = rng.normal(size=16)
    first /= np.linalg.norm(first)
    other = rng.normal(size=(500, 16))
    other -= np.outer(other @ first, first)
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = 0.9 + rng.normal(size=500) * 1e-3
    x = np.concatenate(([first], first * cosine[:, None] + other * np.sqrt(1 - cosine**2)[:, None], [first] * 600))
    ids = [k // 2 for k in range(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)] + [(None, [1.0] * 16)], "vec_id long, embedding array<double>")
    rows = sorted(tuple(r) for r in vectors.near_vectors(frame, 0.9, block=100).where("vec_id is not null").collect())
    assert rows == sorted((i, int(linked[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids))
    assert vectors.near_vectors(frame, 0.9).where("vec_id is null").first()[1:] == (0, None, True)


def test_chained_vectors_of_one_large_block(spark):
    """Links that steps of one tile find one after another, between clusters that chains join."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(100, 24))
    x = (base[rng.integers(0, 100, 2000)] + 0.35 * rng.normal(size=(2000, 24))).astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    label = np.arange(len(x))
    while True:
        new = np.where(linked, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in vectors.near_vectors(frame, 0.9).collect()}
    assert 1 < len(set(label)) < len(x) and len(rows) == len(x)
    for i in range(len(x)):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (linked[i].sum() - 1, label[i], label[i] == i)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 64)), rng.normal(size=(300, 64))
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    (p, sp, ep), (q, sq, eq) = vectors.quantise(x), vectors.quantise(y)
    assert (abs(x @ y.T - (p * sp[:, None]) @ (q * sq[:, None]).T) <= ep[:, None] + eq[None] + ep[:, None] * eq[None] + 1e-12).all() and abs(p).max() <= 127


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {i: find(i) for i in root}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", "ask", '{"text":"x", "n_chars":1}', []), (1, "b", "ask", '{"n_chars":"1","more":2}', ["a"]), (1, "c", "ask", None, ["a", "b", "gone"]), (1, "d", "other", "{}", ["c", "b"]),
         (1, "e", "configure", '{"text":"t"}', ["f"]), (1, "f", "configure", "[1]", ["e"]), (1, "g", "configure", '{"text":"t"}', ["e", "a"]), (1, "h", "configure", '{"text":null}', None), (None, "x", "ask", "{}", []), (2, "a", "ask", '{"text":"x","n_chars":1}', [])],
        "conv_id long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", "two"), (1, "a", "one"), (1, "zz", "lost"), (1, "b", None), (1, None, "n")], "conv_id long, call_id string, content string").withColumn("level", F.lit("clash"))
    rows = {(r.conv_id, r.call_id): r for r in toolcalls.link_calls(calls.withColumn("status", F.lit(0)), results).collect()}
    assert {k[1]: r.level for k, r in rows.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None, "f": None, "g": None, "h": 0, "zz": None}
    assert rows[1, "a"].json == '{"arguments":{"n_chars":1,"text":"x"},"call_id":"a","depends_on":[],"level":0,"name":"ask","result":"one"}'
    assert {k[1]: r.status for k, r in rows.items() if k[0] == 1 and k[1] in "abzz"} == {"a": "linked", "b": "linked", "zz": "orphan"} and rows[2, "a"].status == "unanswered"
    assert rows[1, "b"].errors == ["missing: text", "not a number: n_chars", "unknown field: more"] and rows[1, "c"].errors == ["not an object"] and rows[1, "f"].errors == ["not an object"]
    assert rows[1, "d"].errors == ["unknown tool"] and rows[1, "h"].errors == ["missing: text"] and rows[1, "a"].errors == []
    assert toolcalls.link_calls(calls.where("false"), results.where("false")).count() == 0


def test_odd_arguments_and_deep_graphs(spark):
    """Arguments as they stand, a long text, and calls with two dependencies each, against the longest path."""
    given = [None, "{broken", '"text"', "[1, 2]", '{"b":1,"a":null}', '{"text":"' + "x" * 300_000 + '"}']
    rng = np.random.default_rng(1)
    depends = [[f"c{i}" for i in {max(0, k - 1 - int(d)) for d in rng.integers(0, 6, 2)}] if k else [] for k in range(30)]
    calls = spark.createDataFrame([(1, f"c{k}", "configure", given[k % 6], depends[k]) for k in range(30)], "conv_id long, call_id string, name string, arguments string, depends_on array<string>")
    out = toolcalls.link_calls(calls, spark.createDataFrame([(1, "c0", "r")], "conv_id long, call_id string, content string"))
    rows = {r.call_id: r for r in out.collect()}
    level = {}
    for k in range(30):
        level[f"c{k}"] = max((level[d] + 1 for d in depends[k]), default=0)
    assert {k: r.level for k, r in rows.items()} == level
    want = ["null", '"{broken"', '"text"', "[1,2]", '{"a":null,"b":1}', given[5]]
    assert all(rows[f"c{k}"].json.startswith(f'{{"arguments":{want[k]},"call_id":') for k in range(6)) and [rows[f"c{k}"].errors for k in range(4)] == [["not an object"]] * 4


def test_link_is_a_hash_join(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", "t") for k in range(6)], "conv_id long, turn int, role string, text string")
    plan = toolcalls.link_calls(*toolcalls.tool_traffic(turns))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "FullOuter" in plan


def test_long_chains_of_calls(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}", "x") for k in range(700)] + [(2, 0, None, None, None), (None, 1, "user", "t", "x"), (3, 5, "user", None, "x")], "conv_id long, turn int, role string, text string, name string")
    rows = toolcalls.link_calls(*toolcalls.tool_traffic(turns)).collect()
    assert {r.call_id: r.level for r in rows if r.conv_id == 1} == {f"call-1-{2 * k}": k for k in range(350)} and len(rows) == 351
