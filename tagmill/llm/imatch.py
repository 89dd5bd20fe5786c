"""I-Match fingerprints: terms of a band of inverse document frequency, hashed over randomised subsets of that lexicon."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, exp, floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import arrow_batches, chunks, discard, mix, stash, word_hashes

#: Terms are runs of letters, digits and bytes beyond ASCII.
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The band: terms whose ln(documents / documents with the term) lies between these.
IDF = (1.5, 8.0)
#: Terms of the lexicon that tasks hold at most. A band has at most exp(8) times the terms of a mean document; were that more, its rare end would go.
LEXICON = 1 << 24
#: Randomised subsets: the k-th holds each term with a chance of 2 ** (-k / STEP), the first one the whole lexicon. Of two
#: fingerprints, the FINEST smallest subsets with terms of either are held against each other.
SUBSETS, STEP, FINEST = 120, 11, 32
BATCH_BYTES, FLUSH = 4 << 20, 1 << 20


def term_sets(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, document, term) of each chunk of an Arrow column of texts: distinct terms, sorted within their document."""
    for row, raw, offsets in chunks(column):
        h, words = word_hashes(raw, offsets, _NO_TERM)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield row, len(offsets) - 1, doc[new], h[new]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df): in how many documents of the task each term stands, from time to time."""
    held, size = [], 0

    def folded() -> pa.RecordBatch:
        terms, df = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

    for batch in batches:
        for _, _, _, terms in term_sets(batch.column(0)):
            held.append(terms)
            size += len(terms)
            if size >= 4 * FLUSH:
                yield folded()
                held, size = [], 0
    if held:
        yield folded()


def lexicon(docs: DataFrame, idf: tuple[float, float] = IDF, limit: int = LEXICON) -> np.ndarray:
    """The hashes of the terms whose inverse document frequency lies in the band, counted over all documents."""
    counted = stash(docs.select("text").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    n = docs.count()
    least, most = ceil(n * exp(-idf[1])), floor(n * exp(-idf[0]))
    band = counted.where(F.col("df").between(least, most))
    while band.count() > limit:
        least *= 2
        band = counted.where(F.col("df").between(least, most))
    found = np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))
    discard(counted)
    return found


def memberships(terms: np.ndarray) -> np.ndarray:
    """In which subsets each term lies, one bit each, 64 to a row."""
    bits = np.zeros((-(-SUBSETS // 64), len(terms)), np.uint64)
    for k in range(SUBSETS):
        chance = 2.0 ** (-k / STEP)
        inside = mix(terms + np.uint64(0x51ED270B * (k + 1))) >> np.uint64(11) < np.uint64(chance * (1 << 53))
        bits[k // 64] |= inside.astype(np.uint64) << np.uint64(k % 64)
    return bits


def fingerprints(column, terms: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A row of SUBSETS 16-bit hashes for each text: of its sorted distinct lexicon terms in each subset, 0 where it has none.

    A text without any term of the lexicon has the hash of all its distinct terms instead, in the first four places.
    """
    found = np.zeros((len(column), SUBSETS), np.uint16)
    for row, rows, doc, h in term_sets(column):
        if len(terms):
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            known = terms[at] == h
        else:
            at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        value, mask, owner = mix(h[known]), bits[:, at[known]], doc[known]
        for k in range(SUBSETS):
            inside = np.flatnonzero(mask[k // 64] & np.uint64(1 << k % 64))
            if len(inside):
                owners = owner[inside]
                start = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
                total = mix(np.add.reduceat(value[inside], start) + np.uint64(k)) >> np.uint64(48)
                found[row + owners[start], k] = np.maximum(total, np.uint64(1))
        bare = np.setdiff1d(np.arange(rows), owner)
        if len(bare):
            total = np.zeros(rows + 1, np.uint64)
            other = ~np.isin(doc, owner)
            np.add.at(total, doc[other], mix(h[other] + np.uint64(1)))
            for k in range(4):
                found[row + bare, k] = np.maximum(mix(total[bare] + np.uint64(1 + k)) >> np.uint64(48), np.uint64(1))
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal hashes among the FINEST smallest subsets that hold terms of either text, row by row: in small subsets it comes near the share of common terms."""
    either = (a | b) != 0
    used = either & (np.cumsum(either[:, ::-1], axis=1)[:, ::-1] <= FINEST)
    return (used & (a == b)).sum(axis=1) / used.sum(axis=1)


def edited(text: str, following: str) -> str:
    """The text, its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _judged(ids: list, texts: list[str], terms: np.ndarray, bits: np.ndarray) -> list[pa.Array]:
    """The columns of _ROW for all texts but the last, each with the one after it."""
    new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, other = fingerprints(pa.array(texts, pa.large_string()), terms, bits), fingerprints(pa.array(new, pa.large_string()), terms, bits)
    written = lambda rows: pa.array([r.tobytes() for r in rows.byteswap()], pa.binary())
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        written(own[:-1]), written(other), pa.array(likeness(own[:-1], other), pa.float64()), pa.array(likeness(own[:-1], own[1:]), pa.float64()),
    ]


def fingerprint_documents(docs: DataFrame, idf: tuple[float, float] = IDF) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The lexicon is what lies in the band of inverse document frequency over all documents. Documents are dealt by ranges of
    doc_id and sorted, so each task meets its documents and their next ones in one pass; only the last document of a range
    waits for the first of the next range, and these few pairs are judged by themselves.

    Null texts count as empty; all texts without words have the same fingerprint. Null ids come last, and rows that repeat
    an id follow each other by the hash of their text. A lone row is its own next document. Very long texts are read whole.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with arrow_batches(spark, BATCH_BYTES):
        terms = spark.sparkContext.broadcast(lexicon(rows, idf))
        boundary = [("part", pa.int32()), ("side", pa.string()), ("text", pa.large_string())]

        def plain(columns: list[pa.Array]) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, kind) for _, kind in boundary]], names=names)

        def end(side: str, doc_id, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *[pa.nulls(1, kind) for kind in kinds], pa.array([part()], pa.int32()), pa.array([side]), pa.array([text], pa.large_string())], names=names)

        part = lambda: TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        names = [*(c.split()[0] for c in _ROW.split(", ")), *(c for c, _ in boundary)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, last = memberships(terms.value), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                if last is None:
                    yield end("head", ids[0], texts[0])
                else:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = ids[-1], texts[-1]
                if len(ids) > 1:
                    yield plain(_judged(ids[:-1], texts, terms.value, bits))
            if last is not None:
                yield end("tail", *last)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = memberships(terms.value)
            for batch in batches:
                for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    yield pa.RecordBatch.from_arrays(_judged([doc_id], [text, following], terms.value, bits), names=names[:7])

        order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
        found = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ROW + ", part int, side string, text string"), "fingerprints")
        ends = found.where("side is not null").select("part", "side", "doc_id", "text")
        # One head and one tail for each range, so the numbers of the ranges are few.
        ranges = sorted(r.part for r in ends.where("side = 'head'").select("part").collect())
        follows = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "part int, following int")
        tails = ends.where("side = 'tail'").join(F.broadcast(follows), "part").select("doc_id", "text", "following")
        heads = ends.where("side = 'head'").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
        met = stash(tails.join(heads, "following").select("doc_id", "text", "next_text").mapInArrow(meet, _ROW), "met")
    whole = found.where("side is null").select(*names[:7]).unionByName(met)
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
