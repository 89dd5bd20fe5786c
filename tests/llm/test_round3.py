"""Hard negatives, document fingerprints, phrases, and the hash of words."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmill.llm import common, imatch, lengths, negatives, partenum, phrases, pii, toolcalls

SF = "/root/testdata/sf0.001"


def alternating(n, x, y):
    """The first n letters of the sequence that is extended by its own complement."""
    s = [0]
    while len(s) < n:
        s += [1 - v for v in s]
    return "".join((x, y)[v] for v in s[:n])


def test_words_are_hashed_modulo_a_prime():
    prime = (1 << 61) - 1
    rng = random.Random(1)
    a, b = [rng.randrange(prime) for _ in range(2000)] + [prime - 1, 0], [rng.randrange(prime) for _ in range(2000)] + [prime - 1, prime - 1]
    assert common.mulmod(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % prime for x, y in zip(a, b, strict=True)]

    def brute(word):
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        if len(word) > common._LONG:
            value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 3
        else:
            value = sum((c + 1) * pow(common._BASE, k, prime) for k, c in enumerate(word)) % prime
        return int(common.mix(np.array([(value + len(word) * int(common._P)) % (1 << 64)], np.uint64))[0])

    texts = ["Hello big World", "", "  a\t b ", "x" * 40_000 + " y" * 30_000, None, "Grüße\nvon ihr", "q" * common._LONG + " " + "q" * (common._LONG + 1)]
    for row, raw, offsets in common.chunks(pa.array(texts)):
        h, words = common.word_hashes(raw, offsets)
        for k in range(len(offsets) - 1):
            assert h[words[k] : words[k + 1]].tolist() == [brute(w) for w in (texts[row + k] or "").encode().split()]


@pytest.mark.parametrize("size", [64, 1024, 4096, 16_384, 20_000])
def test_alternating_words_and_their_complements_differ(size):
    ((_, raw, offsets),) = common.chunks(pa.array([" ".join(alternating(size, x, y) for x, y in ("ab", "ba", "cd", "dc"))]))
    assert len(set(common.word_hashes(raw, offsets)[0].tolist())) == 4


def test_texts_without_a_word_in_common_do_not_link(spark):
    texts = [" ".join(alternating(1024, *p) for p in pairs) for pairs in (("ab", "cd", "ef", "gh", "ij"), ("ba", "dc", "fe", "hg", "ji"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in partenum.jaccard_components(docs).collect()}
    assert [(rows[k].n_shingles, rows[k].component_id) for k in (0, 1)] == [(2, 0), (2, 1)]


def mined(rows, positives=5, negatives_=3, low=50, high=95, scale=256, every=50):
    """Brute force over (vec_id, label, vector)."""
    rows = [(i, y, [math.floor(scale * float(v)) for v in x]) for i, y, x in rows if y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for i, y, x in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, z, strict=True)), j, label) for j, label, z in rows if j != i and len(z) == len(x))
        for s, j, _ in [p for p in scored if p[2] == y][:positives]:
            hits = [p for p in scored if p[2] != y and low * -s <= 100 * -p[0] <= high * -s][:negatives_]
            out += [(i, j, k + 1, p[1], -s, -p[0]) for k, p in enumerate(hits)]
    return sorted(out)


SHAPE = "vec_id long, label int, embedding array<float>, code string, i int"


def frame(spark, rows):
    return spark.createDataFrame([(i, y, x, "c", 1) for i, y, x in rows], SHAPE)


@pytest.mark.parametrize(("anchors", "wide"), [(4096, 16384), (3, 50)])
def test_hard_negatives_equal_brute_force(spark, anchors, wide):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 6))
    rows = [(k, int(rng.integers(0, 4)), np.float32(base[rng.integers(0, 8)] + rng.normal(size=6) * 0.4).tolist()) for k in range(400)]
    rows += [(400 + k, int(rng.integers(0, 4)), rows[k % 5][2]) for k in range(200)]  # many ties
    rows += [(601, None, [1.0] * 6), (602, 1, None), (603, 1, [None] + [1.0] * 5), (604, 1, [float("nan")] + [1.0] * 5), (650, 1, [float("inf")] + [1.0] * 5), (651, 1, [1.0, 2.0]), (700, 2, [])]
    found = negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, anchors_per_tile=anchors, rows_per_tile=wide)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows) != []


def test_hard_negatives_of_score_zero_and_few_rows(spark):
    """Positives that score 0 take negatives that score 0, whatever their ids; labels with few rows; negative scores."""
    rows = [(0, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 1, [0.0, 3.0]), (3, 2, [0.0, 2.0]), (4, 2, [-1.0, 0.0]), (5, 1, [-1.0, 1.0]), (6, 3, [0.0, 0.0]), (7, 3, [0.0, 5.0]), (50, 9, [1.0, 1.0]), (8, 3, [0.5, 0.0]), (9, 1, [0.6, 0.0])]
    found = negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows)
    assert any(r[4] == 0 and r[3] < r[1] for r in mined(rows))


def test_hard_negatives_odd_rows(spark):
    rows = [(k, k % 3, [float(k % 5), 1.0]) for k in range(60)]
    twice = frame(spark, rows + rows + [(None, 1, [1.0, 1.0])])
    found = negatives.mine_hard_negatives(twice, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows)
    assert negatives.mine_hard_negatives(twice.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine_hard_negatives(twice, F.lit(False)).count() == 0
    huge = [(0, 1, [3e18, 1e18]), (1, 1, [2e18, 2e18]), (2, 2, [1e18, 2e18]), (3, 2, [1e-9, 1.0])]  # scores beyond 64 bits
    assert negatives.mine_hard_negatives(frame(spark, huge), F.col("vec_id") == 0).count() >= 0
    wide = [(0, 1, [2.0**20, 3.0]), (1, 1, [2.0**20, 5.0]), (2, 2, [2.0**19 + 1, 2.0**19]), (3, 2, [2.0**19 + 2, 7.0])]  # beyond 53 bits
    assert sorted(tuple(r) for r in negatives.mine_hard_negatives(frame(spark, wide), F.col("vec_id") == 0).collect()) == mined(wide)
    with pytest.raises(ValueError):
        negatives.mine_hard_negatives(twice, F.lit(True), high=120)


def test_hard_negatives_of_one_hot_label(spark):
    """A third of all rows are one vector; no task gets more than a few pairs of them for each tile."""
    rng = np.random.default_rng(6)
    rows = [(k, 1, [1.0, 2.0, 0.5]) if k % 3 else (k, int(rng.integers(0, 3)), np.float32(rng.normal(size=3)).tolist()) for k in range(900)]
    found = negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, anchors_per_tile=5, rows_per_tile=100)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows)


def hashes(fingerprint):
    return [fingerprint[k : k + 4] for k in range(0, len(fingerprint), 4)]


def like(a, b):
    pairs = [(x, y) for x, y in zip(hashes(a), hashes(b), strict=True) if (x, y) != ("0000", "0000")][-imatch.FINEST :]
    return sum(x == y for x, y in pairs) / len(pairs)


def terms(text):
    return {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")}


def check_fingerprints(docs, rows, idf=imatch.IDF):
    """Against brute force: lengths, edited texts, likenesses, and which texts have equal hashes in which subsets."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    found = {r.doc_id: r for r in imatch.fingerprint_documents(docs, idf).collect()}
    assert len(found) == len(rows)
    df = Counter(t for _, x in rows for t in terms(x))
    band = {t for t, n in df.items() if math.ceil(len(rows) * math.exp(-idf[1])) <= n <= math.floor(len(rows) * math.exp(-idf[0]))}
    of = {}
    for k, (i, text) in enumerate(rows):
        r, text, following = found[i], text or "", rows[(k + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert math.isclose(r.near_edited, like(r.fingerprint, r.edited_fingerprint)) and math.isclose(r.near_next, like(r.fingerprint, found[rows[(k + 1) % len(rows)][0]].fingerprint))
        for x, f in ((text, r.fingerprint), (new, r.edited_fingerprint)):
            key = frozenset(terms(x) & band) or ("bare", frozenset(terms(x)))
            assert of.setdefault(key, f) == f  # equal terms of the lexicon, equal fingerprints
    assert len(set(of.values())) == len(of)
    words = sorted(band)
    ids = [common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0] for w in words]
    bits = imatch.memberships(np.array(ids, np.uint64))
    inside = [{w for w, b in zip(words, bits[j // 64], strict=True) if int(b) >> j % 64 & 1} for j in range(imatch.SUBSETS)]
    assert inside[0] == band
    seen = [defaultdict(set) for _ in inside]
    for key, f in of.items():
        if not isinstance(key, tuple):
            for j, h in enumerate(hashes(f)):
                assert (h == "0000") == (not key & inside[j])
                seen[j][key & inside[j]].add(h)
    assert all(len(v) == 1 for s in seen for v in s.values())
    return found


def test_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = check_fingerprints(docs, rows)
    assert np.mean([r.near_edited for r in found.values()]) > 0.1 > 10 * np.mean([r.near_next for r in found.values()]) / 2


def test_fingerprints_odd_rows(spark):
    rows = [(5, "Alpha beta gamma"), (1, None), (2, ""), (3, "!!! ..."), (9, "alpha  BETA, gamma!"), (4, "alpha beta gamma delta " * 30_000), (7, "ÄÖ ß naïve 日本語"), (6, "\x00 odd \n\t text"), (None, "alpha beta"), (8, "alpha beta")]
    docs = spark.createDataFrame([(i, t, "h", 1, "p") for i, t in rows], "doc_id long, text string, fingerprint string, n_chars int, part string")
    found = check_fingerprints(docs, rows, idf=(0.3, 8.0))
    assert found[1].fingerprint == found[2].fingerprint == found[3].fingerprint and found[1].near_next == 1.0
    assert found[5].fingerprint == found[9].fingerprint
    assert imatch.fingerprint_documents(docs.where("false")).count() == 0
    (one,) = imatch.fingerprint_documents(docs.where("doc_id = 5")).collect()
    assert one.near_next == 1.0 and one.n_chars == 16
    again = imatch.fingerprint_documents(docs.where("doc_id in (5, 8)").union(docs.where("doc_id = 5"))).collect()
    assert sorted((r.doc_id, r.n_chars) for r in again) == [(5, 16), (5, 16), (8, 10)]


def test_copies_and_near_copies_are_alike(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(200)]
    texts[1], texts[3] = texts[0], [*texts[2][:290], *texts[4][:10]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in imatch.fingerprint_documents(docs, (0.0, 9.0)).collect()}
    assert found[0].fingerprint == found[1].fingerprint and found[0].near_next == 1.0
    assert found[2].near_next > 0.7
    assert max(found[k].near_next for k in range(4, 200)) < 0.4


def brute_phrases(rows, least, top, share=100):
    n, f, out = Counter(), defaultdict(Counter), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        good = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + k] for g, a in good.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= share * counts[g[i : i + k]]}
        scored = []
        for g, a in good.items():
            if g not in gone:
                score, _, left, right = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def language_rows(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "a", "new", "york", "times", "über", "alpha", "beta", "x-y", "日本"] + [f"w{k}" for k in range(200)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(n):
        words = rng.choices(vocabulary, weights=[20] * 12 + [1] * 200, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice([["new", "york", "times"], ["alpha", "beta", "alpha", "beta", "alpha"], passage, passage[10:30], ["a"] * 9])
        text = "".join(w + rng.choice([" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "!", "\x0b", " ;"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize(("least", "top", "share"), [(20, 2000, 100), (5, 40, 100), (10, 2000, 60)])
def test_phrases_equal_brute_force(spark, least, top, share, monkeypatch):
    monkeypatch.setattr(phrases, "PATH", 16)
    rows = language_rows(least)
    docs = spark.createDataFrame([(x, t, "g", 1) for x, t in rows], "lang string, text string, gram string, n int")
    found = sorted(tuple(r) for r in phrases.mine_phrases(docs, least, top, share).collect())
    assert found == brute_phrases(rows, least, top, share) != []


def test_phrases_without_broadcasts_and_with_full_filters(spark, monkeypatch):
    """The same when every join shuffles, and when the filters let everything through."""
    monkeypatch.setattr(phrases, "SIDE_ROWS", 0)
    monkeypatch.setattr(phrases, "frequent_grams", lambda *_: np.full(1 << 4, (1 << 64) - 1, np.uint64))
    rows = language_rows(9, 150)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.mine_phrases(docs, 8, 100).collect()) == brute_phrases(rows, 8, 100)


def test_counts_of_all_lengths_equal_brute_force(spark, monkeypatch):
    """Whatever the stretches of paths: a chain of unary nodes is longer than several of them."""
    monkeypatch.setattr(phrases, "PATH", 4)
    rows = language_rows(31, 120) + [("en", " ".join(f"q{k}" for k in range(60)))] * 9
    docs = spark.createDataFrame(rows, "lang string, text string")
    graph = phrases.phrase_graph(docs, 9)
    words = {(r.lang, r.key): r.word for r in graph["words"].collect()}
    expected = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            expected[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    for k in range(1, 6):
        found = {(r.lang, tuple(words[r.lang, x] for x in r.gram)): r.f for r in graph["counts"][k].where("f >= 9").collect()}
        assert found == {(lang, g): n for lang, c in expected.items() for g, n in c.items() if len(g) == k and n >= 9}, k
    assert {r.lang: r.n for r in graph["totals"].collect()} == {lang: sum(n for g, n in c.items() if len(g) == 1) for lang, c in expected.items()}
    assert graph["paths"].where("stretch > 5").count() > 0


def test_phrases_odd_rows(spark):
    rows = [("en", None), (None, "a b c"), ("en", ""), ("en", " \t\n.,"), ("de", "q" * 50_000 + " r"), ("fr", "x y " * 20_000), ("en", "x" * 20_000 + " y"), ("en", "x" * 20_000 + " y"), ("en", "é ü"), ("en", "é ü")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.mine_phrases(docs, 2, 50).collect()) == brute_phrases(rows, 2, 50)
    assert phrases.mine_phrases(docs.where("false"), 2).count() == 0


def test_paths_hold_the_longest_repeated_passages(spark):
    passage = " ".join(f"p{k}" for k in range(300))
    docs = spark.createDataFrame([("en", f"u{k} {passage} v{k}") for k in range(6)] + [("en", "c d e f g c d e f g c d e f g")] * 6, "lang string, text string")
    graph = phrases.phrase_graph(docs, 5)
    words = {r.key: r.word for r in graph["words"].collect()}
    paths = {tuple(words[k] for k in r.words): r.f for r in graph["paths"].collect()}
    assert paths[tuple(passage.split())] == 6
    counts = {tuple(words[k] for k in r.gram): r.f for r in graph["counts"][3].collect() if r.f >= 5}
    assert counts["p7", "p8", "p9"] == 6 and counts["c", "d", "e"] == 18 and counts["f", "g", "c"] == 12
    assert len(paths) == 3  # the passage, and the cycle without and with the edges over its seam


@pytest.mark.parametrize("mark", [" ", "\n", "\t", "\r\n", " \n\t", "\u3000", "\x85 "])
def test_long_white_space_counts_by_the_pattern(mark):
    encoding = lengths._encoding(lengths.VOCABULARY)
    for n in (4095, 4096, 9000, 30_000):
        run = (mark * n)[:n]
        for text in (run, f"a{run}b", f"a{run}", f"{run}b", f"it's {run}'ll{run}\u00e9{run}7", f"x {run}\x1c y"):
            assert lengths.token_count(encoding, text) == len(encoding.encode_ordinary(text)), (n, text[:3])


def test_very_long_runs_are_counted(spark):
    texts = ["a" + " " * 2_000_000 + "b", "a" + "\n" * 2_000_000 + "b", "\t" * 2_000_000, "a" + " \n" * 1_000_000 + "b c", "ab" * 500_000, "7" * 500_000, "!?" * 250_000]
    docs = spark.createDataFrame([(t, 1, "x") for t in texts] + [(None, 1, "x")], "text string, length int, n_docs string")
    found = {r.length: r.n_docs for r in lengths.count_tokens(docs).collect()}
    # This vocabulary has a token for each white space alone, and for two line ends.
    expected = [2_000_001, 1_000_003, 2_000_000, 2_000_003, 500_000, 250_000, 250_001, 0]
    assert found == Counter(expected)


def test_names_of_many_forms_and_addresses_of_any_script(spark):
    given = {
        "Mr. John Ronald Smith came": "John Ronald Smith", "Mr. J. Smith came": "Smith", "Mr. J. R. Smith came": "Smith", "Frau von Berg kam": "Berg", "write to müller@web.de now": "müller web", "or ivan@почта.рф soon": "ivan почта",
        "Prof. Smith Monday": "Smith", "Mr. John R. van der Berg-Meyer went": "John Berg Meyer", "Dr. J.-P. de la Tour": "Tour", "Mme Marie de la Tour, dit Tour": "Marie Tour",
    }
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace_entities(docs, "k").collect()}
    for k, (text, names) in enumerate(given.items()):
        new = out[k].text
        assert not set(names.split()) & set(re.findall(r"\w+", new)), (text, new)
        assert len(new.split()) == len(text.split()) and [w for w in text.split() if w.islower() and "@" not in w] == [w for w in new.split() if w.islower() and "@" not in w], (text, new)
    assert out[6].text.endswith(" Monday") and re.fullmatch(r"Mr\. [A-Z]\. [A-Z]\. [A-Z]\w+ came", out[2].text) and re.fullmatch(r"Frau von [A-Z]\w+ kam", out[3].text)
    assert out[9].text.split()[-1] == out[9].text.split(",")[0].split()[-1] == out[8].text.split()[-1]


def test_one_person_in_several_documents(spark):
    texts = ["Dr. Anna Berg wrote.", "Mrs. Anna Berg answered.", "Prof. Anna Berg and Dr. Anna Stone", "Mr. Anna Stone", "Dr. Kim Lee", "Anna Berg alone", "Dr. Berg"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace_entities(docs, "k").collect()}
    given, family = re.match(r"Mrs\. (\w+) (\w+) answered", out[1]).groups()
    assert given in pii.NAMES["latin", "female"] and out[0] == f"Dr. {given} {family} wrote." and out[2].startswith(f"Prof. {given} {family} and Dr. ") and out[6] == f"Dr. {family}"
    other = re.match(r"Mr\. (\w+) (\w+)", out[3])
    assert out[2].endswith(f"Dr. {other[1]} {other[2]}") and other[1] != given and out[5] == texts[5]


def test_long_and_repeated_texts_with_names(spark):
    text = "Mr. John Smith met Ms. Jane Doe. " + "Smith said; John Smith and Doe left. " * 3000
    docs = spark.createDataFrame([(1, text), (1, text), (2, "Mr. John Smith")], "doc_id long, text string")
    rows = pii.replace_entities(docs, "k").collect()
    one, two = [r for r in rows if r.doc_id == 1]
    assert one == two and one.n_entities == 2 + 3 * 3000 and not re.search("Smith|John|Doe|Jane", one.text)
    assert one.text.startswith([r.text for r in rows if r.doc_id == 2][0])


def test_a_common_surname_is_dealt_over_tasks(spark, monkeypatch):
    """Every document has the surname; it and others draw more than once."""
    monkeypatch.setattr(common, "CHUNK", 16)
    docs = spark.createDataFrame([(k, f"Dr. Ann Common met Mr. N{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}xy") for k in range(600)], "doc_id long, text string")
    rows = pii.replace_entities(docs.union(docs.select(F.col("doc_id") + 1000, F.lit("Mrs. Ann Common"))), "k").collect()
    assert len({r.text.split(" met ")[0].split(" ", 1)[1] for r in rows}) == 1 and len({r.text.split(" met ")[1] for r in rows if r.doc_id < 1000}) == 600


def brute_levels(calls):
    """calls: {(conv, id): deps}; None on or behind a cycle."""
    level = {}
    while True:
        ready = {k: max([level[k[0], d] for d in deps if (k[0], d) in calls], default=-1) + 1 for k, deps in calls.items() if k not in level and all((k[0], d) in level for d in deps if (k[0], d) in calls)}
        if not ready:
            return {k: level.get(k) for k in calls}
        level |= ready


@pytest.mark.parametrize("in_row", [8192, 5])
def test_levels_equal_brute_force(spark, monkeypatch, in_row):
    monkeypatch.setattr(toolcalls, "IN_ROW", in_row)
    rng = random.Random(in_row)
    calls = {}
    for conv in range(8):
        ids = [f"c{k}" for k in range(conv * 3)]
        rng.shuffle(ids)
        for k, i in enumerate(ids):
            deps = rng.sample(ids[:k], min(k, rng.randrange(4))) + rng.choice([[], [], ["gone"], [i] if conv == 5 else [], [ids[-1]] if conv == 6 and k == 3 else []])
            calls[conv, i] = deps + deps[:1] + rng.choice([[], [None]])
    frame = spark.createDataFrame([(c, i, d or None) for (c, i), d in calls.items()] + [(7, "c0", ["c1"])] * 0, "conv_id long, call_id string, depends_on array<string>")
    found = {(r.conv_id, r.call_id): r.level for r in toolcalls.topological_levels(frame).collect()}
    assert found == brute_levels({k: [d for d in v if d] for k, v in calls.items()})
    assert None in found.values() and max(v for v in found.values() if v is not None) > 3


def test_thousands_of_nested_calls(spark):
    """5,000 calls that each depend on the two before, under ids in no order of theirs."""
    names = [f"{k * 7919 % 5003:04}" for k in range(5000)]
    rows = [(1, n, [names[k - j] for j in (1, 2) if k >= j]) for k, n in enumerate(names)] + [(2, "a", None)]
    frame = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    found = {(r.conv_id, r.call_id): r.level for r in toolcalls.topological_levels(frame).collect()}
    assert found == {(1, n): k for k, n in enumerate(names)} | {(2, "a"): 0}
