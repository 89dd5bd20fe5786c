"""Dealt operators on documents: brute force, held-out accuracy, and the awkward rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tagmill.llm import common, exactdedup, lengths, mixture, packing, partenum, pii, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, h string, size int, sig int, component_id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    long = " ".join(f"w{k % 977}" for k in range(30000))
    texts = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one"), (6, long), (7, long + " tail"), (8, "a" * 300000), (9, "A  b\tc d e f"), (10, "a b c d e f"), (None, "no id"), (None, None), (11, "rep rep"), (11, "rep rep")]
    return spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, 1, "x", 7, 3, 9) for k, (i, t) in enumerate(texts)], COLUMNS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def shingles(text, k):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(rows, k, num, den):
    """Brute force over an inverted index: (size, component) by id."""
    sets = {i: shingles(t, k) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = Counter()
    for ids in index.values():
        shared.update(itertools.combinations(sorted(ids), 2))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if n * den >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_partenum_equals_brute_force(docs, width, num, den):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(docs, width, num, den).collect()}
    assert found == components(rows, width, num, den)


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_partenum_chains_and_families(spark, width, num, den):
    """Families of edited texts, with links that only hold between neighbours and a passage that all share."""
    rng = np.random.default_rng(5)
    common = [f"c{k}" for k in range(50)]
    rows, at = [], 0
    for family in range(12):
        words = [f"f{family}w{k}" for k in rng.integers(0, 10**6, int(rng.integers(20, 300)))] + common
        for _ in range(15):
            words = list(words)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 10**6)}"
            rows.append((at, " ".join(words)))
            at += 1
    found = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, width, num, den)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4000), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32), st.sampled_from([80, 85]))
def test_similar_sets_share_a_signature(size, minus, plus, seed, num):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, size + plus + 5, dtype=np.uint64))
    a = np.sort(pool[:size])
    b = np.sort(np.concatenate((a[min(minus, size - 1) :], pool[size : size + plus])))
    shared = len(np.intersect1d(a, b))
    if shared * 100 >= num * (len(a) + len(b) - shared) and not np.array_equal(a, b):
        assert np.intersect1d(partenum.signatures(a, num, 100), partenum.signatures(b, num, 100)).size


def test_partenum_odd_rows(odd, empty):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.jaccard_components(odd).collect()), key=str)
    by = {r[0]: r for r in rows}
    assert len(rows) == 14 and by[1] == (1, 0, 1) and by[3] == (3, 0, 3) and by[5] == (5, 1, 4) and by[10] == (10, 3, 9) and by[7][2] == 6 and by[11][2] == 11
    assert partenum.jaccard_components(empty).count() == 0


def test_exact_dedup(docs, odd, empty):
    rows = {r.doc_id: r for r in exactdedup.exact_duplicates(docs).collect()}
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    for text, ids in groups.items():
        for i in ids:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept, rows[i].text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    found = exactdedup.exact_duplicates(odd).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 14 and by[2].keep_id == 1 and by[1].group_size == 3 and by[3].keep_id == 3 and by[11].group_size == 2 and by[5].keep_id == 4
    assert exactdedup.keep_first(odd).columns == odd.columns and exactdedup.keep_first(odd).count() == 10
    assert exactdedup.exact_duplicates(empty).count() == 0


def test_exact_dedup_separates_texts_under_one_hash(docs, monkeypatch):
    """With a hash that collides all the time, the bytes still decide."""
    from pyspark.sql import functions as F

    want = sorted(map(tuple, exactdedup.exact_duplicates(docs).collect()))
    monkeypatch.setattr(exactdedup.F, "md5", lambda c: F.lpad(F.length(F.col(c)).cast("string"), 32, "0"))
    assert sorted(map(tuple, exactdedup.exact_duplicates(docs).collect())) == want


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    right = sum(p == t for p, t in out) / len(out)
    caught = sum(p for p, t in out if t == 1) / sum(t for _, t in out)
    assert right > 0.98 and caught > 0.9


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(empty, labels).count() == 0 and toxicity.score_toxicity(odd, labels.where("false")).count() == 14
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_units_cover_whole_words():
    def words(text):
        return [c for piece in toxicity.units(text) for c in piece[2]]

    assert words("idiot") != words("idiom") and words('("Idiot"), x') == words("idiot x") and words("you,idiot/you") == words("you idiot you")
    assert len(words("\u4f60\u662f\u50bb\u74dc")) == 4 and len(set(words("\u0e04\u0e27\u0e32"))) == 3
    runs = [set(next(toxicity.units(t))[0]) for t in ("idiot", "whatanidiotyouare")]
    assert len(runs[0] & runs[1]) == 2
    one, other = (next(toxicity.units(t)) for t in ("not good but bad", "not bad but good"))
    assert sorted(one[2]) == sorted(other[2]) and set(one[3]) != set(other[3])
    long = "ab" * toxicity.PIECE * 2 + " end"
    assert sum(len(piece[0]) for piece in toxicity.units(long)) == len(long) - 1 and words(long)[-1] == words("end")[0]


def test_toxicity_beyond_the_first_letters(spark):
    """What tells the classes apart are late letters, the order of words, or characters of texts without spaces."""
    rng = np.random.default_rng(4)
    clean = [f"plain{chr(97 + k)}" for k in range(20)]
    han = [chr(0x4E00 + k) for k in range(40)]
    texts, toxic = [], []
    for k in range(2400):
        t = int(rng.random() < 0.3)
        fill = [str(w) for w in rng.choice(clean, 12)]
        if k % 3 == 0:
            fill[5] = "idiot" if t else "idiom"
        elif k % 3 == 1:
            fill[5:7] = ["drop", "dead"] if t else ["dead", "drop"]
        else:
            fill = ["".join(rng.choice(han, 12)) + ("\u50bb\u74dc" if t else "\u897f\u74dc") + "".join(rng.choice(han, 12))]
        texts.append(" ".join(fill))
        toxic.append(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    for kind in range(3):
        right = [r.predicted == toxic[r.doc_id] for r in rows if r.doc_id % 3 == kind]
        assert np.mean(right) > 0.95, (kind, np.mean(right))


def test_calibration_keeps_the_class_prior(spark):
    """With the ordinary rows cut to a few, scores stay near those of the full fit, whose mean is the toxic share."""
    rng = np.random.default_rng(11)
    toxic = rng.random(6000) < 0.1
    texts = [" ".join(rng.choice(["awful", "nasty"] if rng.random() < (0.25 if t else 0.1) else [f"plain{chr(97 + k)}" for k in range(20)]) for _ in range(12)) for t in toxic]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)], "doc_id long, toxic int")
    full, cut = ([r.score for r in toxicity.score_toxicity(docs, labels, fit_rows=n).orderBy("doc_id").collect()] for n in (8000, 140))
    assert abs(np.mean(full) - 0.1) < 0.03 and abs(np.mean(cut) - np.mean(full)) < 0.03 and np.mean(np.abs(np.array(cut) - full)) < 0.06


def test_shared_backoff_of_unseen_expressions_is_neutral(spark):
    docs = spark.createDataFrame([(1, "quiet words"), (2, "quiet words quiet words")], "doc_id long, text string")
    counted = toxicity.count_cells(docs, spark.createDataFrame([], "id long, toxic int"))
    assert not toxicity.log_ratio(counted).any()


def test_probabilities_equal_brute_force(spark):
    """Word and pair probabilities against plain Kneser-Ney over words; and the models sum to one."""
    rng = np.random.default_rng(9)
    vocabulary = [f"word{chr(97 + k)}" for k in range(26)]
    texts = [[str(w) for w in rng.choice(vocabulary, 30, p=np.arange(26, 0, -1) / 351)] for _ in range(40)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    label = {k: int(k % 3 == 0) for k in range(30)}
    counted = toxicity.count_cells(docs, spark.createDataFrame(list(label.items()), "id long, toxic int"))
    odds, _ = toxicity.class_odds(counted)
    found = {r.cell: (r.p_toxic, r.p_ordinary) for r in odds.collect()}

    cell = {w: int(next(toxicity.units(w))[2][0]) for w in vocabulary}
    pair_cell = {(v, w): int(next(toxicity.units(f"{v} {w}"))[3][0]) for v in vocabulary for w in vocabulary}
    assert len(set(cell.values())) == 26 and len(set(pair_cell.values())) == 676
    everywhere = Counter(w for t in texts for w in t)
    pairs = {y: Counter(p for k, z in label.items() if z == y for p in itertools.pairwise(texts[k])) for y in (1, 0)}
    words = {y: Counter(w for k, z in label.items() if z == y for w in texts[k]) for y in (1, 0)}
    kinds = set(pairs[1]) | set(pairs[0])
    cells = 1 << toxicity.BITS[2]

    def shared(w):
        lower = (1 + sum(p[1] == w for p in kinds)) / (cells + len(kinds))
        return (max(everywhere[w] - 0.75, 0) + sum(min(n, 0.75) for n in everywhere.values()) * lower) / sum(everywhere.values())

    def word(y, w):
        held = sum(min(n, 2) for n in words[y].values())
        return (max(words[y][w] - 2, 0) + held * shared(w)) / sum(words[y].values())

    def pair(y, v, w):
        after = [n for p, n in pairs[y].items() if p[0] == v]
        return (max(pairs[y][v, w] - 2, 0) + sum(min(n, 2) for n in after) * word(y, w)) / sum(after) if after else word(y, w)

    for w in vocabulary:
        assert found[cell[w]] == pytest.approx((word(1, w), word(0, w)), rel=1e-9)
    for v, w in kinds:
        assert found[pair_cell[v, w]] == pytest.approx((pair(1, v, w), pair(0, v, w)), rel=1e-9)
    rest = (cells - 26) / (cells + len(kinds)) * sum(min(n, 0.75) for n in everywhere.values()) / sum(everywhere.values())
    for y in (1, 0):
        none = sum(min(n, 2) for n in words[y].values()) / sum(words[y].values()) * rest
        assert sum(found[cell[w]][1 - y] for w in vocabulary) + none == pytest.approx(1)
        for v in vocabulary[:5]:
            held = sum(min(n, 2) for p, n in pairs[y].items() if p[0] == v) / sum(n for p, n in pairs[y].items() if p[0] == v)
            assert sum(pair(y, v, w) for w in vocabulary) + held * none == pytest.approx(1)


def test_surrogates(spark):
    text = "Mr. John Smith <john.smith@acme.co> and JOHN.SMITH@ACME.CO, +1 (366) 555-9807 or +1-366-555-9807, 4944339490429605, 10.1.2.3, Frau Anna Müller; Госпожа Анна Петрова."
    docs = spark.createDataFrame([(1, text), (2, "Mail john.smith@acme.co or jane@acme.co, Mrs. Smith"), (3, "clean"), (4, None), (5, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace_entities(docs, "k").collect()}
    one, two = out[1].text, out[2].text
    assert out[1].kinds == ["male", "email", "email", "phone", "phone", "card", "ip", "female", "female"] and out[2].kinds == ["email", "email", "female"]
    for secret in ("John", "Smith", "acme", "ACME", "366", "9807", "4944339490429605", "10.1.2.3", "Müller", "Анна", "Петрова"):
        assert secret not in one + two
    mail = re.search(r"<(.*?)>", one)[1]
    assert mail in two and mail.upper() in one and mail.split("@")[1][:9] == re.findall(r"@\S{9}", two)[1][1:]
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1-\d{3}-\d{3}-\d{4}", one)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1
    card = [int(c) for c in re.search(r"\b\d{16}\b", one)[0]][::-1]
    assert (sum(card[::2]) + sum(d * 2 - 9 * (d > 4) for d in card[1::2])) % 10 == 0
    assert re.search(r"Mr\. (\w+) \w+ <", one)[1] in pii.NAMES["latin", "male"] and re.search(r"Госпожа (\w+) [А-Я]\w+\.", one)[1] in pii.NAMES["cyrillic", "female"]
    assert (out[3].text, out[4].text, out[5].text) == ("clean", None, "")


def test_surrogates_keep_types_and_persons(spark):
    texts = [
        "password=пароль password=!!!! password=пароль1 password=1234", "Mr. John Smith met Mr. Smith and Mr. SMITH. John Smith left, said Smith; Dr. John Smith and Prof. Dr. Smith stayed. Blacksmith. Miss Jane Doe",
        "DE89370400440532013000, GB29 NWBK 6016 1331 9268 19", "10.1.2.3 192.168.1.7 172.20.1.1 127.0.0.1 8.8.8.8", "+49 30 123456 and +44 20 7946 0958 and +380 44 123 4567", "Κύριος Νίκος Παππάς, श्री अजय शर्मा, السيد أحمد حسن",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace_entities(docs, "k").collect()}
    out = {k: r.text for k, r in rows.items()}
    old, new = texts[0].split(), out[0].split()
    assert len(set(new)) == 4 and not set(old) & set(new) and all(n.startswith("password=") for n in new) and re.fullmatch(r"password=[а-я]{6}", new[0]) and "пароль" not in out[0]
    given, family = re.match(r"Mr\. (\w+) (\w+) met", out[1]).groups()
    assert out[1].startswith(f"Mr. {given} {family} met Mr. {family} and Mr. {family.upper()}. {given} {family} left, said {family}; Dr. {given} {family} and Prof. Dr. {family} stayed. Blacksmith. Miss ")
    assert given in pii.NAMES["latin", "male"] and not re.search("John|Smith|Jane|Doe", out[1])
    for a, b in zip(texts[2].split(", "), out[2].split(", "), strict=True):
        plain = b.replace(" ", "")
        assert a[:2] == b[:2] and a != b and [k for k, c in enumerate(a) if c == " "] == [k for k, c in enumerate(b) if c == " "]
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    blocks = [re.match(x, y) for x, y in zip((r"10\.", r"192\.168\.", r"172\.(1[6-9]|2\d|3[01])\.", r"127\.", r"(?!10\.)[1-8]\d\."), out[3].split(), strict=True)]
    assert all(blocks) and not set(texts[3].split()) & set(out[3].split())
    assert re.fullmatch(r"\+49 \d\d \d{6} and \+44 \d\d \d{4} \d{4} and \+380 \d\d \d{3} \d{4}", out[4]) and "123456" not in out[4]
    assert re.fullmatch(r"Κύριος [\u0370-\u03FF\u1F00-\u1FFF]+ [\u0370-\u03FF]+, श्री [\u0900-\u097F]+ [\u0900-\u097F]+, السيد [\u0600-\u06FF]+ [\u0600-\u06FF]+", out[5])
    assert not re.search("Νίκος|Παππάς|अजय|शर्मा|أحمد|حسن", out[5])


def test_surrogates_equal_brute_force(spark):
    """Over a corpus of many repeated mentions: what stands between them is untouched, equal entities have one surrogate
    everywhere, different ones different ones, and none is an entity of the corpus."""
    rng = np.random.default_rng(12)
    stems = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    pools = {
        "email": [f"{s}@{t}.org" for s, t in zip(stems, stems[1:], strict=False)], "ip": [f"192.168.{a}.{b}" for a, b in rng.integers(1, 250, (300, 2))], "card": [f"4{k:015}" for k in rng.integers(0, 10**15, 300)],
        "ssn": [f"{k // 10**6:03}-{k // 10**4 % 100:02}-{k % 10**4:04}" for k in rng.integers(0, 10**9, 300)], "phone": [f"+1 ({k // 10**7}) {k // 10**4 % 1000:03}-{k % 10**4:04}" for k in rng.integers(2 * 10**9, 10**10, 300)],
        "key": [f"password={s}" for s in stems], "male": [f"Mr. {s.title()}" for s in stems], "female": [f"Ms. {s.upper()}" for s in stems],
    }
    texts = [" | ".join(str(rng.choice(pools[k])) for k in rng.choice(list(pools), 6)) for _ in range(1500)]
    rows = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}

    def entity(kind, value):
        value = re.sub(r"^(Mr\. |Ms\. |password=)", "", value)
        return ("family" if kind in ("male", "female") else kind, value.lower() if kind != "key" else value)

    found = defaultdict(set)
    for k, text in enumerate(texts):
        old, new = text.split(" | "), rows[k].text.split(" | ")
        assert len(old) == len(new) == rows[k].n_entities
        for a, b, kind in zip(old, new, rows[k].kinds, strict=True):
            assert a in pools[kind] and re.sub(r"\w", "", a) == re.sub(r"\w", "", b) or kind == "email"
            found[entity(kind, a)].add(entity(kind, b))
    assert all(len(v) == 1 for v in found.values())
    drawn = [next(iter(v)) for v in found.values()]
    assert len(set(drawn)) == len(drawn) and not set(drawn) & set(found)


def test_surrogates_stay_distinct(spark):
    """More names than the lists hold without repetition, and surrogates that would be entities."""
    docs = spark.createDataFrame([(k, f"Mr. Name{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)} met 10.0.{k // 250}.{k % 250}") for k in range(3000)], "doc_id long, text string")
    rows = pii.replace_entities(docs, "k").collect()
    assert len({r.text.split(" met ")[0] for r in rows}) == 3000 and len({r.text.split(" met ")[1] for r in rows}) == 3000
    assert not {r.text.split(" met ")[1] for r in rows} & {f"10.0.{k // 250}.{k % 250}" for k in range(3000)}


def test_surrogates_odd_rows(odd, empty):
    rows = pii.replace_entities(odd, "k").collect()
    assert len(rows) == 14 and all(r.n_entities == 0 for r in rows) and pii.replace_entities(empty, "k").count() == 0


def test_token_histogram(spark, docs, odd, empty):
    encoding = lengths._encoding(lengths.VOCABULARY)
    sizes = sorted(len(encoding.encode_ordinary(r.text)) for r in docs.collect())
    rows = {r.length: r for r in lengths.count_tokens(docs).collect()}
    assert sorted(rows) == sorted(set(sizes))
    for n, r in rows.items():
        longer = [s for s in sizes if s > n]
        assert (r.n_docs, r.n_tokens, r.docs_above, r.tokens_above) == (sizes.count(n), n * sizes.count(n), len(longer), sum(longer))
        assert r.truncated_total == sum(min(s, n) for s in sizes)
    histogram = lengths.count_tokens(docs)
    limits = spark.createDataFrame([(1,), (100,), (777,), (10**6,)], "limit long")
    assert {r.limit: (r.tokens, r.cut_docs) for r in lengths.truncated_total(histogram, limits).collect()} == {n: (sum(min(s, n) for s in sizes), sum(s > n for s in sizes)) for n in (1, 100, 777, 10**6)}
    assert lengths.quantile(histogram, 0.5).first().length == sizes[len(sizes) // 2 - 1]
    assert sum(r.n_docs for r in lengths.count_tokens(odd).collect()) == 14 and lengths.count_tokens(empty).count() == 0


def test_pieces_keep_the_count():
    encoding = lengths._encoding(lengths.VOCABULARY)
    text = " ".join(["word", "don't  go", "x\n\ny", "été", "12 345", "..."] * 300)
    assert "".join(lengths.pieces(text, 100)) == text and sum(len(encoding.encode_ordinary(p)) for p in lengths.pieces(text, 100)) == len(encoding.encode_ordinary(text))


def test_quantiles_of_many_documents(spark):
    histogram = spark.createDataFrame([(5, 9_999_996, 4, 1.0), (9, 4, 0, 1.0)], "length long, n_docs long, docs_above long, share_at_most double")
    assert [lengths.quantile(histogram, q).first().length for q in (0.5, 0.9999996, 1.0)] == [5, 5, 9]


def test_mixing(docs, odd, empty):
    rows = mixture.mix(docs).collect()
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    total, by = sum(sizes.values()), defaultdict(list)
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r.size and len(r.placements) * r.size == r.taken
        by[r.source].append(r)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    size = {s: sum(r.size for r in by[s]) for s in by}
    capped = set()
    while True:
        level = (1.5 * total - sum(2 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in by if s not in capped and weight[s] * level > 2 * size[s]}
        if not more:
            break
        capped |= more
    for s, rs in by.items():
        target = 2 * size[s] if s in capped else weight[s] * level
        assert abs(rs[0].target - target) < 1e-6 * total and abs(sum(r.taken for r in rs) - target) <= max(r.size for r in rs)
    assert sorted(map(str, mixture.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert len(mixture.mix(odd).collect()) == 14 and mixture.mix(empty).count() == 0


def test_splitting_tree_is_exact(spark):
    targets = mixture.source_targets(spark.createDataFrame([(s, 1000 + 37 * k, 10) for k, s in enumerate(["a", "b", "c", None])], "source string, source_size long, n long"))
    quotas = mixture.shard_quotas(targets, 8, 16).collect()
    shards, sources = Counter(), Counter()
    for q in quotas:
        shards[q.shard] += q.blocks
        sources[q.source] += q.blocks
    assert set(shards.values()) == {16} and len(shards) == 8 and sum(sources.values()) == 128


def test_small_sources_are_placed(spark):
    """Beside a hot source, one of 0.01 % of the words and several smaller ones keep every taken word, also as documents."""
    sizes = {"hot": [2000] * 100} | {f"s{k:02}": [n] for k, n in enumerate([20, 20, 5, 1] + [3] * 16)} | {None: [2, 2]}
    rows = [(f"{s}-{k}", " ".join(["w"] * n), s) for s, ns in sizes.items() for k, n in enumerate(ns)]
    given = spark.createDataFrame(rows, "doc_id string, text string, source string")
    mixed = mixture.mix(given).collect()
    taken = {r.doc_id: r.taken // r.size for r in mixed}
    assert all(len(r.placements) * r.size == r.taken for r in mixed) and {r.source for r in mixed if r.taken} == set(sizes)
    assert Counter(r.doc_id for r in mixture.mixed_documents(given).collect()) == {i: n for i, n in taken.items() if n}


def test_more_sources_than_blocks(spark):
    targets = spark.createDataFrame([(f"s{k}", 10, 1, 20.0) for k in range(600)] + [("none", 0, 1, 0.0)], "source string, source_size long, n long, target double")
    quotas = mixture.shard_quotas(targets, 4, 16).collect()
    shards, sources = Counter(), Counter()
    for q in quotas:
        shards[q.shard] += q.blocks
        sources[q.source] += q.blocks
    assert len(sources) == 600 and min(sources.values()) >= 1 and len(shards) == 4 and len(set(shards.values())) == 1


@pytest.mark.parametrize("n,m,d", [(20, 7, 10), (9, 9, 4), (12, 0, 6), (400, 30, 200), (50000, 20000, 25000)])
def test_draws_follow_hypergeometric_odds(spark, n, m, d):
    """The distribution function at every grid point u is the exact one: outcomes cover intervals of u as long as their odds."""
    from pyspark.sql import functions as F

    grid = 20000
    rows = spark.range(grid).select(F.expr(mixture.hypergeometric(f"{n}", f"{m}", f"{d}", f"((id + 0.5D) / {grid})")).alias("x")).groupBy("x").count().collect()
    low, high = max(0, d + m - n), min(d, m)
    assert all(low <= r.x <= high for r in rows) and sum(r["count"] for r in rows) == grid
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    found = {r.x: r["count"] / grid for r in rows}
    for x in range(low, high + 1):
        odds = math.exp(log(m, x) + log(n - m, d - x) - log(n, d))
        assert abs(found.get(x, 0) - odds) < 1.5 / grid + 1e-6


def test_groups_of_sources_are_drawn_exactly(spark, monkeypatch):
    """Many sources, of which a draw takes few at a time, over many shards: every quota and every shard adds up."""
    monkeypatch.setattr(mixture, "SOURCES", 7)
    monkeypatch.setattr(mixture, "GROUP", 3)
    targets = mixture.source_targets(spark.createDataFrame([(f"s{k:03}", 1 + k * k % 997, 10) for k in range(90)] + [(None, 5, 1)], "source string, source_size long, n long"))
    quotas = mixture.shard_quotas(targets, 32, 16).collect()
    shards, sources = Counter(), Counter()
    for q in quotas:
        shards[q.shard] += q.blocks
        sources[q.source] += q.blocks
    assert len(shards) == 32 and set(shards.values()) == {16} and len(sources) == 91
    total = sum(r.target for r in targets.collect())
    for r in targets.collect():
        assert abs(sources[r.source] - 1 - r.target / total * (512 - 91)) <= 1.5
    dealt = mixture.block_shards(spark.createDataFrame(quotas)).collect()
    assert Counter((r.k, r.shard) for r in dealt) == {("t" if q.source is None else "s" + q.source, q.shard): q.blocks for q in quotas} and len({(r.k, r.block) for r in dealt}) == 512


def test_shards_lie_whole_and_in_order(docs):
    from pyspark.sql import functions as F

    rows = mixture.mixed_documents(docs, shard_words=20000).select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    where, sizes = defaultdict(list), Counter()
    for r in mixture.mix(docs, shard_words=20000).collect():
        for p in r.placements:
            where[p.shard].append((p.order, r.doc_id))
            sizes[p.shard] += r.size
    assert len(where) == 32 and max(sizes.values()) < 3 * sum(sizes.values()) / 32
    want = {s: [i for _, i in sorted(x)] for s, x in where.items()}
    found = defaultdict(list)
    for r in rows:
        found[r.part].append(r.doc_id)
    assert {p: found[p] for p in found} == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 5)), min_size=1, max_size=9, unique_by=lambda x: x[0]), st.integers(1, 4))
def test_buckets_are_optimal(rows, buckets):
    rows.sort()
    n, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def cost(ends):
        return sum(k * (min(e for e in ends if e >= x) - x) for x, k in rows)

    best = min(cost([*e, n[-1]]) for k in range(min(buckets, len(n))) for e in itertools.combinations(n[:-1], k))
    assert cost(packing.best_boundaries(n, c, n * c, buckets)) == best


def test_buckets_of_long_lengths():
    """Every length is a boundary to choose, however long; against the plain recurrence."""
    rng = np.random.default_rng(3)
    n = np.unique(np.concatenate((rng.integers(1, 400, 150), rng.integers(15000, 60000, 250))))
    k = rng.integers(1, 50, len(n))
    c = np.concatenate(([0], np.cumsum(k)))
    cost = np.where(np.arange(len(n) + 1) == 0, 0.0, np.inf)
    for _ in range(6):
        cost = np.array([0.0] + [min(cost[i] + n[j - 1] * (c[j] - c[i]) for i in range(j)) for j in range(1, len(n) + 1)])
    ends = packing.best_boundaries(n, k, n * k, 6)
    assert len(ends) <= 6 and ends[-1] == n[-1] and (np.array(ends)[np.searchsorted(ends, n)] * k).sum() == cost[-1]


def test_packing(docs, odd, empty):
    rows = packing.pack(docs, buckets=6, budget=3000).collect()
    batches = defaultdict(list)
    for r in rows:
        assert r.length <= r.bucket_length and r.padding == r.bucket_length - r.length
        batches[r.batch_id].append(r)
    partial = Counter()
    for rs in batches.values():
        room = max(1, 3000 // rs[0].bucket_length)
        assert sorted(r.position for r in rs) == list(range(len(rs))) and len(rs) <= room and len({r.bucket_length for r in rs}) == 1
        partial[rs[0].bucket_length] += len(rs) < room
    assert len(rows) == docs.count() and len(partial) == 6 and max(partial.values()) <= 1
    assert len(packing.pack(odd).collect()) == 14 and packing.pack(empty).count() == 0


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "batch_id"} <= set(rows[0].asDict())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = toxicity.drop_toxic(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    first = {}
    for r in sorted(clean, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    parts = components([(r.doc_id, r.text) for r in first.values()], 5, 80, 100)
    left = {i for i, (_, c) in parts.items() if i == c}
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in first.values() if r.doc_id in left}
    taken = Counter(r.doc_id for r in rows)
    assert set(taken) <= left and max(taken.values()) <= 2
    assert abs(sum(size[i] * n for i, n in taken.items()) - 1.5 * sum(size.values())) < 20 * max(size.values())
    mixed = mixture.mix(docs.join(spark.createDataFrame([(i,) for i in left], "doc_id long"), "doc_id", "left_semi")).where("taken > 0").collect()
    assert taken == Counter({r.doc_id: r.taken // r.size for r in mixed})


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    """Every stage on nulls, empty and long texts, repeats, no rows, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(4, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("_id", "_p", "_sha", "_score", "id", "sha", "row", "order", "shard", "k", "key", "before", "taken", "size", "component", "_part", "score", "count")
    wide = odd.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for table in (wide, wide.where("false")):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == table.columns
            docs = common.stash(out, "stage")
            assert (docs.count() > 0) == (table is wide)
            if name == "exact dedup" and table is wide:
                left = docs.select("doc_id", "text", "_sha").collect()
                assert {r._sha for r in left} == {2} and sorted((r.doc_id for r in left if r.doc_id), key=int) == [1, 3, 4, 6, 7, 8, 9, 10, 11]


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = spark.createDataFrame([(1, "a  b", "x"), (1, "a b", "y"), (2, "a b", "z"), (1, "c", "u"), (3, None, "v"), (3, "", "w")], "doc_id long, text string, note string")
    left = [sorted(map(str, exactdedup.keep_first(t).collect())) for t in (rows, rows.repartition(3), rows.orderBy("note", ascending=False))]
    assert left[0] == left[1] == left[2] and len(left[0]) == 3


def test_hot_signatures_are_split(spark):
    """One family of thousands of near copies that share their signatures, over many partitions."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words, f"x{rng.integers(0, 10**6)}"])) for k in range(3000)] + [(k, f"only one {k} of its kind") for k in range(3000, 3400)]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.doc_id: r.component_id for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(found[k] == 0 for k in range(3000)) and all(found[k] == k for k in range(3000, 3400))


def test_plans_of_the_mixing_tree_hold_no_sums(spark, monkeypatch):
    plans, stash = [], mixture.stash
    monkeypatch.setattr(mixture, "stash", lambda df, tag: plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or stash(df, tag))
    targets = spark.createDataFrame([(f"s{k}", 10.0 + k) for k in range(9)], "source string, target double")
    quotas = {}
    for many in (mixture.SOURCES, 2):
        monkeypatch.setattr(mixture, "SOURCES", many)
        quotas[many] = mixture.shard_quotas(targets, 16, 8).groupBy("shard").agg({"blocks": "sum"}).collect()
        trees = [p for tag, p in plans if tag == "tree"][1:]
        assert trees and all("Aggregate" not in p for p in trees) and ("Join" in trees[-1]) == (many == 2)
        plans.clear()
    assert all(len(q) == 16 and {r[1] for r in q} == {8} for q in quotas.values())


def test_plans_of_near_dedup_hold_their_input_once(spark, monkeypatch):
    """Joins within joins, with keys of more rows than a task takes, and running sums: the driver plans each again and again."""
    plans, stash = [], common.stash
    kept = lambda df, tag: plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or stash(df, tag)
    monkeypatch.setattr(partenum, "stash", kept)
    monkeypatch.setattr(common, "stash", kept)
    monkeypatch.setattr(common, "CHUNK", 4)
    monkeypatch.setattr(common, "NARROW", 4, raising=False)
    monkeypatch.setattr(partenum, "NARROW", 4, raising=False)
    shared = [f"w{k}" for k in range(60)]
    rows = [(100 * f + k, " ".join([*shared[: 30 * (f % 2)], *(f"f{f}x{j}" for j in range(60)), f"y{k}"])) for f in range(6) for k in range(20)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components(rows, 4, 85, 100) and len({c for _, c in found.values()}) == 6
    assert all(p.count("Join ") <= 6 for tag, p in plans if tag in ("likely", "links", "edges")) and {"likely", "links", "edges", "open"} <= {tag for tag, _ in plans}

    sums = common.running_sums(spark.range(3000).selectExpr("id", "id % 3 as k", "id div 7 as g", "id * id as v"), ["k"], "g", ["id"], "v")
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {r.id: r.before for r in sums.collect()} == {i: sum(j * j for j in range(i % 3, i, 3)) for i in range(3000)}
