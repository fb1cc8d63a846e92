"""Ordinal quality classifier: a cumulative-link regression of graded ratings on hashed text.

All grades share one weight for each hashed feature; ordered thresholds part them: P(grade <= k) = sigmoid(t_k - w.x).
From one score follow the expected grade and the probability of at least a wanted grade.

Features are the distinct words of a text and a few marks of its shape, hashed to 32 bits. It is fitted on a bounded
sample of rated rows (SAMPLE), in one task that holds only the sample; only features that a number of rated texts have and
that differ between the grades get a weight (at most FEATURES), so the model is small at any size of the corpus. All rows
are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ALNUM, map_texts, utf8, with_columns

#: Rated rows that are fitted on, at most about this many.
SAMPLE = 12_000
#: Features with a weight, at most; texts that must have one; how far its share must differ, in standard errors.
FEATURES, LEAST, FAR = 20_000, 5, 4.0
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
#: Grades are 0 (toxic), 1 (poor) and 2 (good); rows are kept if they are good with at least this probability.
GRADES, GOOD, KEEP = 3, 2, 0.5


class Model(NamedTuple):
    weights: dict[int, float]
    #: Ascending, one fewer than the grades; empty without ratings.
    thresholds: tuple[float, ...]


def grade(quality: Column, toxic: Column) -> Column:
    """0 if toxic, else 1 if quality is 0, else 2; null if a label is null."""
    return F.when(quality.isNotNull() & toxic.isNotNull(), F.when(toxic != 0, 0).when(quality == 0, 1).otherwise(2))


def features(text: str | None) -> set[int]:
    """Hashes of the distinct words, and of marks for the share of symbols, capitals, short lines and distinct words."""
    raw = utf8(text)
    words = raw.translate(ALNUM).split()
    kinds = set(words)
    size = max(1, len(raw))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"!")))
    capitals = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = (b"\0symbols %d" % min(9, 50 * symbols // size), b"\0capitals %d" % min(9, 10 * capitals // size),
             b"\0distinct %d" % (10 * len(kinds) // max(1, len(words))), b"\0words %d" % len(words).bit_length())
    return set(map(zlib.crc32, kinds)).union(map(zlib.crc32, marks))


def score(found: set[int], model: Model) -> float:
    return sum(map(model.weights.get, found, repeat(0.0)))


def tails(value: float, thresholds: tuple[float, ...]) -> list[float]:
    """P(grade > k) for each threshold."""
    return [1 / (1 + float(np.exp(np.clip(t - value, -50, 50)))) for t in thresholds]


def solve(grades: np.ndarray, columns: np.ndarray, starts: np.ndarray, width: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the mean log-likelihood with a ridge on the weights.

    Row i has the features columns[starts[i]:starts[i + 1]]. Thresholds are the first one and the logs of the gaps.
    """
    rows = np.repeat(np.arange(len(grades)), np.diff(starts))
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades)) / max(1, len(grades)), 0.01, 0.99)[:-1]
    first = np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    theta = np.concatenate([np.zeros(width), first[:1], gaps])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    for step in range(1, STEPS + 1):
        w, cut = theta[:width], np.cumsum(np.concatenate([theta[width : width + 1], np.exp(theta[width + 1 :])]))
        f = np.bincount(rows, w[columns], len(grades))
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        upper, lower = sigmoid(edges[grades + 1] - f), sigmoid(edges[grades] - f)
        upper, lower = np.where(grades + 1 == n_grades, 1.0, upper), np.where(grades == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_f = (up - low) / len(grades)
        by_cut = np.array([low[grades == k + 1].sum() - up[grades == k].sum() for k in range(n_grades - 1)]) / len(grades)
        later = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([
            np.bincount(columns, by_f[rows], width) + RIDGE * w, later[:1], later[1:] * np.exp(theta[width + 1 :])])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope ** 2
        theta = theta - RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return theta[:width], np.cumsum(np.concatenate([theta[width : width + 1], np.exp(theta[width + 1 :])]))


def fit_rows(batches: Iterator[pa.RecordBatch], n_grades: int) -> Iterator[pa.RecordBatch]:
    """Fit on all rows (id, grade, features) of one partition; gives (feature, weight), then thresholds with feature -1."""
    rows = sorted((r["id"], r["grade"], r["features"]) for b in batches for r in b.to_pylist())
    if not rows:
        return
    grades = np.array([r[1] for r in rows])
    lengths = np.array([len(r[2]) for r in rows])
    flat = np.concatenate([np.array(r[2], np.int64) for r in rows])
    names, columns = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), lengths)
    total = np.bincount(columns, minlength=len(names))
    far = np.zeros(len(names))
    for g in range(n_grades):
        n = int((grades == g).sum())
        share = total / len(rows)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * max(1, n))
        far = np.maximum(far, np.abs(np.bincount(columns[grades[owner] == g], minlength=len(names)) - share * n) / error)
    good = np.flatnonzero((total >= LEAST) & (far >= FAR))
    good = good[np.argsort(-far[good], kind="stable")[:FEATURES]]
    place = np.full(len(names), -1)
    place[good] = np.arange(len(good))
    here = place[columns] >= 0
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner[here], minlength=len(rows)))])
    w, cut = solve(grades, place[columns][here], starts, len(good), n_grades)
    yield pa.RecordBatch.from_pydict({
        "feature": pa.array([*names[good], *[-1] * len(cut)], pa.int64()), "weight": pa.array([*w, *cut], pa.float64())})


def fit(
    docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, n_grades: int = GRADES, id_column: str = "doc_id",
    text_column: str = "text",
) -> Model:
    """Fit on about sample rows of docs that ratings (id_column, grade) rates; the driver gets the model only.

    Null grades and ids rate nothing. Of several ratings of one id the lowest counts. Without rated rows the model is empty.
    """
    rated = (ratings.filter(F.col("grade").isNotNull() & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("__id")).agg(F.min("grade").alias("grade")))
    total = rated.count()
    chosen = rated.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, total))))
    texts = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "__id")

    def rows(ids, grades, texts):
        for i, g, text in zip(ids, grades, texts):
            yield i, g, sorted(features(text))

    source = texts.select(F.col("__id").cast("long").alias("id"), "grade", "text")
    made = map_texts(source, ["id", "grade", "text"], "id long, grade int, features array<long>", rows)
    found = made.coalesce(1) if not total else made.repartition(1)
    out = found.mapInArrow(lambda batches: fit_rows(batches, n_grades), "feature long, weight double").collect()
    return Model({r.feature: r.weight for r in out if r.feature >= 0}, tuple(r.weight for r in out if r.feature < 0))


def rate(
    docs: DataFrame, model: Model, wanted: int = GOOD, text_column: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """The columns of docs in keep (all by default) with __grade (expected) and __tail (probability of the wanted grade or better).

    Null and empty texts have no words and go by the shape marks. With an empty model both are null. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts):
        model = shared.value
        for text in texts:
            if not model.thresholds:
                yield None, None
                continue
            above = tails(score(features(text), model), model.thresholds)
            yield round(sum(above), 6), round(above[wanted - 1], 6)

    return with_columns(docs, [text_column], "__grade double, __tail double", rows, keep)


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a table (doc_id, quality, toxic)."""
    return labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))


def keeps(tail: Column) -> Column:
    return F.coalesce(tail >= KEEP, F.lit(True))
