"""Toxicity by two class-conditional Kneser-Ney models of letter runs, beginnings, words and pairs of words, compared by length-normalised log-likelihood."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm import common

#: Four tables of hashed cells: runs of up to four letters, beginnings of words, whole words, pairs of words. Their size bounds what is collected.
BITS = (18, 18, 20, 20)
START = [sum(1 << b for b in BITS[:k]) for k in range(5)]
CELLS = START[4]
RUN = 4
#: Discount of a class's count of a cell: one seen twice or less in a class is left to the lower model.
DISCOUNT = 2.0
#: A log ratio beyond this margin counts as evidence.
MARGIN = 1.5
#: Labelled rows of each class, at most, that the class counts and the calibration use (the smallest by a hash of the id).
TRAIN_ROWS, FIT_ROWS = 40_000, 8_000
#: Characters of a text that are read at a time, up to the next white space if there is some within as many again.
PIECE = 1 << 18
_POWERS: list[np.ndarray] = []
_GAP = re.compile(r"\s")
#: Scripts without spaces between words (Thai to Tibetan, Burmese, Khmer, kana, ideographs): each character is a word.
ALONE = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def _kinds() -> np.ndarray:
    """0 for what stands between words, 1 for letters, marks and digits, 2 for those that are words alone; the last entry is for what follows."""
    out = np.array([unicodedata.category(chr(k))[0] in "LMN" for k in range(1 << 16)], np.uint8)
    for low, high in ALONE:
        out[low : high + 1] *= 2
    out[-1] = 2
    return out


_TABLE: list[np.ndarray] = []


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + PIECE, start + 2 * PIECE)
        stop = gap.start() if gap else min(len(text), start + 2 * PIECE)
        yield text[start:stop]
        start = stop


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2^64 of an odd base, and of its inverse: hashes that are cut to cells of 20 bits at most anyway."""
    if not _POWERS or len(_POWERS[0]) < n:
        base, size = 0x9E3779B97F4A7C15, max(n, PIECE)
        found = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for p in found:
            p[0] = 1
        _POWERS[:] = [np.multiply.accumulate(p) for p in found]
    return _POWERS[0][:n], _POWERS[1][:n]


def units(text: str | None) -> Iterator[tuple[np.ndarray, ...]]:
    """By pieces, the cells of the letter runs that end at each letter, of words' first RUN letters, of words, and of pairs, with the cells of a pair's two words.

    Words are cut at all but letters, marks and digits, and hashed whole; a run stays within what is between two cuts.
    """
    if not _TABLE:
        _TABLE.append(_kinds())
    last = np.zeros(0, np.uint64)
    for piece in _pieces(text or ""):
        code = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _TABLE[0][np.minimum(code, 0xFFFF)]
        letter = kind > 0
        if not letter.any():
            continue
        inside, alone = np.zeros(len(code), bool), kind == 2
        inside[1:] = letter[:-1]
        c = code * letter
        run, before = c * _ODD[0], c
        for k in range(1, RUN):
            shifted = np.zeros_like(c)
            shifted[1:] = before[:-1]
            before = shifted * inside
            run += before * _ODD[k]
        run = run[letter]
        run ^= run >> np.uint32(15)
        run *= np.uint32(0x2C1B3C6D)
        start = letter & (~inside | alone)
        start[1:] |= letter[1:] & alone[:-1]
        stop = letter.copy()
        stop[:-1] &= ~letter[1:] | start[1:]
        first, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        up, down = _power(len(code))
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(c * up, out=total[1:])
        word = common.mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
        begun = np.minimum(end, first + RUN)
        stem = common.mix((total[begun] - total[first]) * down[first] + (begun - first).astype(np.uint64))
        row = np.concatenate((last, word))
        pair = common.mix(row[:-1] * np.uint64(0x9E3779B97F4A7C15) + row[1:])
        last = word[-1:]
        stems, word, pairs = ((h >> np.uint64(64 - BITS[k])).astype(np.int64) + START[k] for k, h in ((1, stem), (2, row), (3, pair)))
        runs = (run >> np.uint32(32 - BITS[0])).astype(np.int64)
        yield runs, stems, word[len(row) - len(first) :], pairs, word[:-1], word[1:]


def cells(text: str | None) -> np.ndarray:
    """The cells of all runs, beginnings, words and pairs; none for null, empty and blank texts."""
    return np.concatenate([np.zeros(0, np.int64), *[part for piece in units(text) for part in piece[:4]]])


def label_rows(labels: DataFrame) -> DataFrame:
    """(id, toxic, part): one row per labelled id outside the held-out quarter; part 3 calibrates, parts 0 and 1 count. A row that says toxic wins."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.select(F.col("doc_id").alias("id"), "toxic", part.alias("part")).where("part <> 2")


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of each class, by a hash of the id; the result may be broadcast."""
    by = rows.withColumn("_h", F.xxhash64("id"))
    return F.broadcast(by.where("toxic = 1").orderBy("_h").limit(most).union(by.where("toxic <> 1").orderBy("_h").limit(most)).drop("_h"))


def count_cells(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(cell, everywhere, toxic, ordinary, first, second): counts of each cell in all documents and in the two classes.

    Pairs are counted in the classes' documents only; first and second are the cells of their words, -1 for other cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((3, CELLS), np.int64)
        ends = np.full((2, CELLS), -1, np.int32)
        waiting: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}
        size = 0

        def flush() -> None:
            for k, parts in waiting.items():
                if parts:
                    table[k] += np.bincount(np.concatenate(parts), minlength=CELLS)
                    parts.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for runs, stems, words, pairs, first, second in units(text):
                    if toxic is None:
                        waiting[0] += [runs, stems, words]
                    else:
                        waiting[1 if toxic == 1 else 2] += [runs, stems, words, pairs]
                        np.maximum.at(ends[0], pairs, first.astype(np.int32))
                        np.maximum.at(ends[1], pairs, second.astype(np.int32))
                    size += len(runs) + 3 * len(words)
                    if size > 4_000_000:
                        flush()
                        size = 0
        flush()
        at = np.flatnonzero(table.any(axis=0))
        everywhere = table.sum(axis=0)
        for k in range(0, len(at), 65536):
            x = at[k : k + 65536]
            columns = [x.astype(np.int32), everywhere[x], table[1][x], table[2][x], ends[0][x], ends[1][x]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["cell", "everywhere", "toxic", "ordinary", "first", "second"])

    marked = docs.select(F.col("doc_id").alias("id"), "text").join(train.select("id", "toxic"), "id", "left").select("text", "toxic")
    parts = marked.mapInArrow(run, "cell int, everywhere long, toxic long, ordinary long, first int, second int")
    sums = [F.sum(c).alias(c) for c in ("everywhere", "toxic", "ordinary")]
    return parts.groupBy("cell").agg(*sums, F.max("first").alias("first"), F.max("second").alias("second"))


def class_odds(counted: DataFrame) -> tuple[DataFrame, list[float]]:
    """(cell, p_toxic, p_ordinary) of the cells that a class knows, and by kind the log ratio of all cells that none knows.

    Of all but pairs both classes discount their own counts and hand the discounted mass to one shared model: the counts of
    the whole corpus, themselves discounted and backed off, for words to the number of words they follow
    (Kneser-Ney's continuation counts). So a word that neither class knows well says little. Of pairs, each class discounts
    its counts after the first word and hands the mass to its own model of words: p is that of the second word after the first.
    """
    kinds = len(BITS)
    kind = F.when(F.col("cell") < START[1], 0)
    for k in range(1, kinds):
        kind = kind.when(F.col("cell") < START[k + 1], k)
    rows = counted.withColumn("kind", kind)
    kept = lambda c, d: F.greatest(F.col(c) - d, F.lit(0.0))
    given = lambda c, d: F.least(F.col(c).cast("double"), F.lit(d))
    sums = [F.count(F.lit(1)), F.sum(kept("everywhere", 0.75)), F.sum(given("everywhere", 0.75)), *[f for c in ("toxic", "ordinary") for f in (F.sum(c), F.sum(given(c, DISCOUNT)))]]
    totals = {r[0]: [float(x or 0) for x in r[1:]] for r in rows.groupBy("kind").agg(*sums).collect()}
    n_pairs = totals.get(3, [0.0])[0]
    follows = rows.where("kind = 3").groupBy(F.col("second").alias("cell")).agg(F.count(F.lit(1)).alias("follows"))
    known = rows.where("kind < 3 and toxic + ordinary > 0").join(follows, "cell", "left")

    odds = {"toxic": F.lit(None), "ordinary": F.lit(None)}
    unknown = []
    for k in range(kinds - 1):
        filled, own, mass, *classes = totals.get(k, [0.0] * 7)
        mass = mass or 1.0
        seen = F.coalesce("follows", F.lit(0)) if k == 2 and n_pairs else F.when(F.col("everywhere") > 0, 1).otherwise(0)
        lower = (seen + 1) / ((1 << BITS[k]) + (n_pairs if k == 2 and n_pairs else filled))
        shared = (kept("everywhere", 0.75) + mass * lower) / (own + mass)
        left = []
        for c, total, held in (("toxic", *classes[:2]), ("ordinary", *classes[2:])):
            p = (kept(c, DISCOUNT) + held * shared) / total if held else shared
            odds[c] = F.when(F.col("kind") == k, p).otherwise(odds[c])
            left.append(np.log(held / total) if held else 0.0)
        unknown.append(left[0] - left[1])
    words = known.select("cell", *[p.alias(f"p_{c}") for c, p in odds.items()])

    pairs = rows.where("kind = 3").select("cell", "first", "second", "toxic", "ordinary")
    sides = [f for c in ("toxic", "ordinary") for f in (F.sum(c).alias(f"n_{c}"), F.sum(given(c, DISCOUNT)).alias(f"held_{c}"))]
    after = pairs.groupBy("first").agg(*sides)
    second = words.select(F.col("cell").alias("second"), F.col("p_toxic").alias("w_toxic"), F.col("p_ordinary").alias("w_ordinary"))
    paired = pairs.join(after, "first").join(second, "second")
    chance = [F.when(F.col(f"n_{c}") > 0, (kept(c, DISCOUNT) + F.col(f"held_{c}") * F.col(f"w_{c}")) / F.col(f"n_{c}")).otherwise(F.col(f"w_{c}")).alias(f"p_{c}") for c in ("toxic", "ordinary")]
    return words.unionByName(paired.select("cell", *chance)), unknown


def log_ratio(counted: DataFrame) -> np.ndarray:
    """log p_toxic - log p_ordinary by cell, 0 for pairs of neither class. Only the cells that a class knows come to the driver."""
    odds, unknown = class_odds(counted)
    out = np.zeros(CELLS, np.float32)
    for k, value in enumerate(unknown):
        out[START[k] : START[k + 1]] = value
    rows = odds.select("cell", (F.log("p_toxic") - F.log("p_ordinary")).cast("float").alias("ratio"))
    table = rows.toArrow()  # columns of numbers, not objects
    out[table["cell"].to_numpy()] = table["ratio"].to_numpy()
    return out


#: Of runs, beginnings, words and pairs each: the mean log ratio; its part beyond the margin per unit, and per square root of the units.
FEATURES = 12


def features(text: str | None, ratio: np.ndarray) -> np.ndarray:
    """The features of a text, all 0 without words. A pair of neither class counts as its second word does."""
    sums = np.zeros((4, 3))
    for runs, stems, words, pairs, _, second in units(text):
        paired = ratio[pairs]
        for k, r in enumerate((ratio[runs], ratio[stems], ratio[words], np.where(paired == 0, ratio[second], paired))):
            sums[k] += len(r), r.sum(dtype=np.float64), np.maximum(r - MARGIN, 0).sum(dtype=np.float64)
    n = np.maximum(sums[:, 0], 1)
    return np.concatenate((sums[:, 1] / n, sums[:, 2] / n, sums[:, 2] / np.sqrt(n)))


@dataclass
class Model:
    """The table of log ratios, and a logistic calibration: scaled features, their weights and the intercept."""

    ratio: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows outside the held-out quarter; shared counts come from all documents.

    Class counts use parts 0 and 1 of the labelled ids, the calibration part 3, so it sees texts whose counts it did not
    make; its rows are weighted to each class's true count. The driver gets the log ratios of at most CELLS cells and at
    most 2 * fit_rows rows of features. Unless calibration has labels of both classes every score is 0.
    """
    known = label_rows(labels)
    counted = common.stash(count_cells(docs, _bounded(known.where("part in (0, 1)"), train_rows)), "cells")
    ratio = log_ratio(counted)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    fit = known.where("part = 3")
    pick = docs.select(F.col("doc_id").alias("id"), "text").join(_bounded(fit, fit_rows), "id")
    # A row of a class that was cut stands for as many of its labels.
    stands = {r["is_toxic"]: max(1.0, r["count"] / fit_rows) for r in fit.groupBy((F.col("toxic") == 1).alias("is_toxic")).count().collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [features(t, shared.value).tolist() for t in pdf["text"]]})

    sample = pick.select("text", "toxic").mapInPandas(run, "toxic int, x array<double>").toArrow()
    rows = np.array(sorted([*x, float(t == 1)] for x, t in zip(sample["x"].to_pylist(), sample["toxic"].to_pylist(), strict=True)), dtype=np.float64).reshape(-1, FEATURES + 1)
    x, y = rows[:, :-1], rows[:, -1]
    if not (y == 1).any() or not (y == 0).any():  # nothing tells the classes apart, so nothing is found toxic
        return Model(ratio, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), -50.0])
    weight = np.where(y == 1, stands.get(True, 1.0), stands.get(False, 1.0))
    mean = np.average(x, axis=0, weights=weight)
    scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)), 1e-9)
    return Model(ratio, mean, scale, _logistic((x - mean) / scale, y, weight))


def scorer(docs: DataFrame, model: Model):
    """A column function: the score of a text between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            x = np.array([features(t, model.ratio) for t in texts], dtype=np.float64).reshape(-1, FEATURES)
            yield pd.Series(model.score(x), dtype="float64")

    return F.pandas_udf(score, "double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Three passes over the whole texts: counts (folded to one table per task, then summed), the calibration's rows, scores.
    No text is shuffled. Labels of a doc_id whose crc32 mod 4 is 2 are never read.

    Null, empty and blank texts get the score of texts without evidence. Null ids are scored and not held out. Repeated rows
    are scored alike; repeated labels count once, toxic if any row says so; null labels are ignored. Other columns are
    ignored; an empty table gives no rows.
    """
    score = scorer(docs, train(docs, labels, **options))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents below the threshold, with all their columns.

    Null, empty and blank texts have the score of texts without evidence, rows without a doc_id are judged like others, and
    repeated rows alike. An empty table gives no rows.
    """
    score = scorer(docs, train(docs, labels, **options))
    return docs.where(score("text") < threshold)
