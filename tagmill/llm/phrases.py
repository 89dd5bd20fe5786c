"""Phrase collocations from a weighted de Bruijn graph of words: longest grams are edges between the grams they overlap in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.llm.common import _LOWER, _P, arrow_batches, chunks, discard, mix, span_hashes, split_join, stash, word_spans

#: Words of the longest phrase.
LONGEST = 5
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_BLANK = _BREAK.copy()
_BLANK[[9, 32]] = True
#: Grams are counted ahead by so many bits of their hash, and the frequent ones put into a filter of so many bits at most (128 MB).
CELL_BITS, MOST_BITS = 40, 1 << 30
#: Rows of grams that a task folds at a time, edges of one row of a compacted path, rows of counts that are broadcast at most,
#: parts in which a language's best phrases are ranked first, partitions whose grams one task folds.
FLUSH, PATH, SIDE_ROWS, PARTS, MERGED = 1 << 19, 1024, 250_000, 64, 8
BATCH_BYTES = 8 << 20
#: All occurrences of a node have the same neighbour before them, and the same one after.
UNARY = "`left` = f and `right` = f"
_GRAM = "lang string, gram array<long>, n long, word string"


def words_of(column, langs: list[str]) -> Iterator[tuple]:
    """(hashes, joined, row, language, spans, bytes) of each chunk of texts: joined says which words follow the one before
    within a piece; language is a hash of each word's language."""
    keys = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    salt = np.array([keys[x] for x in langs], np.uint64)
    for row, raw, offsets in chunks(column):
        low = _LOWER[raw]
        first, last, begins = word_spans(low, offsets, _BLANK)
        if not len(first):
            continue
        h = np.maximum(span_hashes(low, first, last), np.uint64(1))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
        breaks = np.zeros(len(low) + 1, np.int64)
        np.cumsum(_BREAK[low], out=breaks[1:])
        joined = np.zeros(len(h), bool)
        joined[1:] = (breaks[first[1:]] == breaks[last[:-1]]) & (doc[1:] == doc[:-1])
        yield h, joined, row + doc, salt[row + doc], (first, last), low


def gram_hashes(h: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """Hashes of the grams of 1 to LONGEST words that begin at each word; the last words' longer ones have no meaning."""
    found = [mix(h ^ salt)]
    for k in range(1, LONGEST):
        after = np.zeros(len(h), np.uint64)
        after[: max(0, len(h) - k)] = h[k:]
        found.append(mix(found[-1] * _P + after))
    return found


def lengths_by(joined: np.ndarray, frequent: list[np.ndarray]) -> np.ndarray:
    """How long the longest gram from each word is, all of whose parts are among the frequent ones (by length); 0 for none."""
    ok, total = frequent[0], frequent[0].astype(np.int64)
    for k in range(1, len(frequent)):
        both = np.zeros(len(ok), bool)
        both[:-1] = ok[:-1] & ok[1:]
        if k == 1:
            both[:-1] &= joined[1:]
        ok = both & frequent[k]
        total += ok
    return total


def seen(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether both bits of a gram are set: the one that the low bits of its cell tell and that of the high bits."""
    size = len(bits) * 64
    found = np.ones(len(grams), bool)
    for at in ((grams >> np.uint64(64 - CELL_BITS)) & np.uint64(size - 1), grams >> np.uint64(65 - size.bit_length())):
        found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _counted(likely):
    """(cell, n) of the task's words and pairs of neighbours; or, once the frequent ones are known, of the longer grams of such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def folded() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held) >> np.uint64(64 - CELL_BITS), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int32))], names=["cell", "n"])

        for batch in batches:
            for h, joined, _, salt, _, _ in words_of(batch.column(1), batch.column(0).to_pylist()):
                grams = gram_hashes(h, salt)
                if likely is None:
                    found = [grams[0], grams[1][:-1][joined[1:]]]
                else:
                    pairs = lengths_by(joined, [seen(likely.value, g) for g in grams[:2]]) == 2
                    found, many = [], pairs
                    for k in range(2, LONGEST):
                        many = many & np.r_[pairs[k - 1 :], np.zeros(min(k - 1, len(h)), bool)]
                        found.append(grams[k][many])
                held += found
                size += sum(map(len, found))
                if size >= 8 * FLUSH:
                    yield folded()
                    held, size = [], 0
        if size:
            yield folded()

    return run


def frequent_grams(texts: DataFrame, least: int, likely=None) -> np.ndarray:
    """A filter of bits by hash in which every gram of at least so many occurrences is found, and few others.

    Grams are counted by 40 bits of their hash, each task's folded first. The filter has 64 bits for each frequent one, up to MOST_BITS, and
    sets two of them: it is of bounded size and only spares work, as what it lets through is counted exactly later.
    """
    counted = texts.mapInArrow(_counted(likely), "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = stash(counted.select("cell"), "frequent")
    size = min(MOST_BITS, 1 << max(16, (64 * counted.count()).bit_length()))
    both = F.array(F.col("cell").bitwiseAND(F.lit(size - 1)), F.shiftright("cell", CELL_BITS + 1 - size.bit_length()))
    rows = counted.select(F.explode(both).alias("at")).select(F.shiftright("at", 6).alias("at"), F.col("at").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = rows.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    discard(counted)
    found = np.zeros(size >> 6, np.uint64)
    found[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return found


def _grams(likely):
    """(lang, gram, n), vocabulary and totals of a task's texts, folded from time to time.

    Each word gives the longest gram from it, of five words at most, that may be frequent: those of five are edges, shorter ones ends,
    where the piece ends or nothing longer is frequent. So a frequent gram occurs as often as rows begin with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size, known, totals = {}, [], 0, set(), {}

        def emit(lang, grams, n, word) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), grams, pa.array(n, pa.int64()), pa.array(word, pa.string())], names=["lang", "gram", "n", "word"])

        def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            """Equal rows become one; rows that the sort leaves apart are summed later."""
            rows, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            key = rows[:, 0]
            for k in range(1, LONGEST + 1):
                key = mix(key * _P + rows[:, k])
            order = np.argsort(key)
            rows, n = rows[order], n[order]
            start = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
            return rows[start], np.add.reduceat(n, start)

        def told(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            filled = rows[:, 1:] != 0
            offsets = np.r_[0, np.cumsum(filled.sum(axis=1))].astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[:, 1:][filled].view(np.int64)))
            langs = list(names)
            return emit([langs[k] for k in rows[:, 0].astype(np.int64)], grams, n, [None] * len(rows))

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for x in langs:
                names.setdefault(x, len(names))
            place = np.array([names[x] for x in langs], np.uint64)
            for h, joined, row, salt, (first, last), low in words_of(batch.column(1), langs):
                for k, n in zip(*np.unique(place[row], return_counts=True), strict=True):
                    totals[int(k)] = totals.get(int(k), 0) + int(n)
                grams = gram_hashes(h, salt)
                short, long = likely
                many = lengths_by(joined, [seen(short.value, g) for g in grams[:2]] + [seen(long.value, g) for g in grams[2:]])
                at = np.flatnonzero(many)
                rows = np.zeros((len(at), LONGEST + 1), np.uint64)
                rows[:, 0] = place[row[at]]
                for k in range(LONGEST):
                    on = np.flatnonzero(many[at] > k)
                    rows[on, k + 1] = h[at[on] + k]
                held.append((rows, np.ones(len(rows), np.int64)))
                size += len(rows)
                if size >= 2 * FLUSH:
                    held = [folded(held)]
                    size = len(held[0][1])
                    if size >= FLUSH:
                        yield told(*held[0])
                        held, size = [], 0
                _, one = np.unique(grams[0][at], return_index=True)
                new = [k for k in at[one].tolist() if (int(place[row[k]]), int(h[k])) not in known]
                if new:
                    known.update((int(place[row[k]]), int(h[k])) for k in new)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32)), pa.array(h[new].view(np.int64)))
                    yield emit([langs[row[k]] for k in new], keys, [0] * len(new), [low[first[k] : last[k]].tobytes().decode() for k in new])
                if len(known) > FLUSH:  # what is told again is the same
                    known = set()
        if size:
            yield told(*folded(held))
        if totals:
            every = list(names)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(totals) + 1, np.int32)), pa.array([], pa.int64()))
            yield emit([every[k] for k in totals], none, list(totals.values()), [None] * len(totals))

    return run


def compact_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, stretch, words, f): maximal chains of edges (lang, gram, f) through unary nodes, each all of whose occurrences have one neighbour on either side.

    Pointers to the edge before are doubled until all end at a chain's first edge; the edges of a chain then are one row, or several of PATH
    edges, which overlap in a node. A chain always has a first edge: where a node's first occurrence in a text stands, it has no neighbour
    that came earlier. Each round's table is written to the shared folder.
    """
    edges = stash(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    unary = nodes.where(UNARY).select("lang", F.col("gram").alias("node"))
    enters = edges.select("lang", F.slice("gram", 2, LONGEST - 1).alias("node"), F.col("id").alias("up"))
    leaves = edges.select("lang", F.slice("gram", 1, LONGEST - 1).alias("node"), "id")
    before = unary.join(enters, ["lang", "node"]).join(leaves, ["lang", "node"]).where("id <> up").select("id", "up")
    n = edges.count()
    at = stash(edges.select("id").join(before, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.col("up").isNotNull().cast("long").alias("far")), "pointers")
    moved = True
    while moved:
        step = split_join(at, at.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("far").alias("more")), ["up"], n)
        step = stash(step.select("id", F.col("top").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("top") != F.col("up")).alias("moved")), "pointers")
        moved = not step.where("moved").isEmpty()
        discard(at)
        at = step
    rows = edges.join(at.select("id", "up", "far"), "id").groupBy(F.col("up").alias("path"), F.floor(F.col("far") / PATH).alias("stretch"))
    rows = rows.agg(F.first("lang").alias("lang"), F.first("f").alias("f"), F.array_sort(F.collect_list(F.struct("far", "gram"))).alias("g"))
    return rows.select("lang", "stretch", F.concat(F.col("g")[0]["gram"], F.transform(F.slice("g", 2, PATH), lambda x: F.element_at(x["gram"], -1))).alias("words"), "f")


def _shorter(level: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(lang, gram, f, left, right) of grams of k words from those of k + 1: what flows out of a gram, plus the ends that are it.

    left and right are the counts of its most frequent extension by a word on either side.
    """
    none = F.lit(0).cast("long")
    flows = level.select("lang", F.slice("gram", 1, k).alias("gram"), "f", none.alias("left"), F.col("f").alias("right"))
    flows = flows.unionByName(level.select("lang", F.slice("gram", 2, k).alias("gram"), none.alias("f"), F.col("f").alias("left"), none.alias("right")))
    closing = ends.where(F.size("gram") == k).select("lang", "gram", "f", none.alias("left"), none.alias("right"))
    return flows.unionByName(closing).groupBy("lang", "gram").agg(F.sum("f").alias("f"), F.max("left").alias("left"), F.max("right").alias("right"))


def phrase_graph(docs: DataFrame, least: int) -> dict:
    """The graph of phrases with at least so many occurrences, of docs (text, lang): its tables.

    counts: (lang, gram, f, left, right) by length 1 to 5, exact where f >= least; paths: compacted chains of
    frequent edges; words: (lang, key, word) of each word's hash; totals: (lang, n) of all words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with arrow_batches(spark, BATCH_BYTES):
        short = spark.sparkContext.broadcast(frequent_grams(texts, least))
        long = spark.sparkContext.broadcast(frequent_grams(texts, least, short))
        # A gram leaves each task once, so the fewer tasks, the fewer partial counts: one takes several partitions while every core has some.
        tasks = max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // MERGED)
        told = stash(texts.coalesce(tasks).mapInArrow(_grams((short, long)), _GRAM), "grams")
    totals = told.where("word is null and size(gram) = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    words = told.where("word is not null").groupBy("lang", F.col("gram")[0].alias("key")).agg(F.min("word").alias("word"))
    grams = stash(told.where("word is null and size(gram) > 0").groupBy("lang", "gram").agg(F.sum("n").alias("f")), "edges")
    edges, ends = grams.where(F.size("gram") == LONGEST), grams.where(F.size("gram") < LONGEST)
    none = F.lit(0).cast("long")
    counts = {LONGEST: edges.withColumns({"left": none, "right": none})}
    nodes = counts[LONGEST - 1] = stash(_shorter(edges, ends, LONGEST - 1), "nodes")
    paths = stash(compact_paths(edges.where(F.col("f") >= least), nodes.where(F.col("f") >= least)), "paths")
    # Nodes inside a path have the path's count and come from its row, with the first of a stretch that goes on; the others come from the flow.
    begin = paths.withColumn("i", F.when(F.col("stretch") > 0, 1).otherwise(2)).where(F.size("words") - (LONGEST - 1) >= F.col("i"))
    inside = begin.select("lang", "f", F.explode(F.expr(f"transform(sequence(i, size(words) - {LONGEST - 1}), k -> slice(words, k, {LONGEST - 1}))")).alias("gram"))
    level = nodes.where((F.col("f") < least) | ~F.expr(UNARY)).select("lang", "gram", "f").unionByName(inside)
    for k in range(LONGEST - 2, 0, -1):
        level = counts[k] = stash(_shorter(level, ends, k), "grams")
    return {"counts": counts, "paths": paths, "words": words, "totals": totals}


def mine_phrases(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 5 words with a >= least occurrences.

    Words are runs of anything but space and tab in pieces between `.,;:!?` and line ends, A-Z lower-cased. A phrase is cut after each of
    its words but the last: l and r are the parts' counts, and floor(1000 a n / (l r)) of the lowest-scoring cut (the
    first of several) is its score, exact in decimals. Phrases inside a longer one that has 100 f >= share * a go.

    1. Words and pairs of neighbours, then longer grams of frequent pairs, are counted by hash; a filter of bounded size holds the
       frequent ones and some others. No frequent phrase holds a gram that isn't in it.
    2. Each word gives the longest such gram from it: five words are an edge between nodes of four, fewer are an end. Each task's are
       folded before they move. Node flows plus ends give the counts of shorter grams, length by length, and each
       gram's best extensions. Chains through unary nodes are compacted to paths by pointer doubling.
    3. Only counts of at least `least` are joined to the cuts; each language's phrases are ranked in parts before the last
       ranking sees the best of each.

    Null texts are empty, a null language is `und`; repeated rows count each; very long texts and words are read whole. Words
    are told apart by 61-bit hashes. Other columns are ignored; an empty table gives no rows.
    """
    graph = phrase_graph(docs, least)
    counts = graph["counts"]
    longer = F.greatest("left", "right")
    kept = [counts[k].where((F.col("f") >= least) & ~((longer >= least) & (longer * 100 >= F.col("f") * share))).select("lang", "gram", F.col("f").alias("a")) for k in range(2, LONGEST + 1)]
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    found = stash(found, "candidates")
    parts = counts[1].where(F.col("f") >= least).select("lang", "gram", "f")
    for k in range(2, LONGEST):
        parts = parts.unionByName(counts[k].where(F.col("f") >= least).select("lang", "gram", "f"))
    parts = stash(parts, "parts")
    known, many = parts.count(), found.count()

    def joined(rows: DataFrame, side: DataFrame, size: int, keys: list[str], count: int) -> DataFrame:
        return rows.join(F.broadcast(side), keys) if size <= SIDE_ROWS else split_join(rows, side, keys, count)

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
    cuts = cuts.withColumns({"x": F.slice("gram", 1, F.col("k")), "y": F.expr("slice(gram, k + 1, size(gram) - k)")})
    cuts = joined(cuts, parts.toDF("lang", "x", "l"), known, ["lang", "x"], (LONGEST - 1) * many)
    cuts = joined(cuts, parts.toDF("lang", "y", "r"), known, ["lang", "y"], (LONGEST - 1) * many)
    totals = stash(graph["totals"], "totals")
    cuts = joined(cuts, totals, totals.count(), ["lang"], (LONGEST - 1) * many)
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast({wide('a')} * {wide('n')} as decimal(35, 0)) * 1000 div (cast({wide('l')} * {wide('r')} as decimal(38, 0)))")
    scored = cuts.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    scored = scored.select("lang", "gram", "a", "n", "s.score", "s.l", "s.r").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    best = stash(scored.withColumn("_r", F.rank().over(W.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_r") <= top).drop("_r"), "best")

    vocabulary = stash(graph["words"], "words")
    spelt = best.select("lang", "part", "gram", F.posexplode("gram").alias("at", "key"))
    spelt = joined(spelt, vocabulary, vocabulary.count(), ["lang", "key"], LONGEST * best.count())
    spelt = spelt.groupBy("lang", "gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(spelt, ["lang", "gram"])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("_r") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
