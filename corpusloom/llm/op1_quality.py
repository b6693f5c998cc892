"""Quality classifier: Naive Bayes support vectors.

Features are indicators of byte n-grams (2 to 5 bytes, hashed to 2**17 buckets) of the whole text,
of the text with letters folded to one sign, and of its words. Each indicator is scaled by the
log-count ratio of its bucket between the two classes, the vector is scaled to length 1, and a
linear hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a
logistic curve fitted on rows that the model was not fitted on, shifted to the share of good
labels among all learning rows.

The model is fitted on the driver from a bounded sample: per class the ``per_class`` labelled rows
with the smallest xxhash64(doc_id), spread over all labels, as far as their features have no more than
``sample_bytes``. Scoring runs in tasks over all rows.

Rows: null and empty texts have no features and get a score from the intercept; labels other than
0 and 1 and null ids are not learnt from; an id with contradicting labels counts in both classes;
with a class missing every score is the share of good labels (0.5 without labels). Other columns
are never read and stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, written

BITS = 17
PER_CLASS = 2500
SAMPLE_BYTES = 128 << 20  # of features of the sample; a text has 512 KB at most
THRESHOLD = 0.3
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = ord("a")
_FOLD[ord("A") : ord("Z") + 1] = ord("A")
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[128:] = ord("a")


def _grams(codes: np.ndarray, sizes: range, salt: int, mark: np.ndarray) -> None:
    h = np.full(len(codes), salt, np.uint32)
    for n in range(1, sizes.stop):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MULT[(n - 1) % 5]
        h ^= h >> np.uint32(15)
        if n in sizes:
            mark[h & np.uint32((1 << BITS) - 1)] = True


def features(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Sorted distinct buckets of the text; mark is a reusable all-False array of 2**BITS."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    _grams(raw.astype(np.uint32), range(2, 5), 1, mark)
    _grams(_FOLD[raw].astype(np.uint32), range(3, 6), 2, mark)
    found = np.flatnonzero(mark)
    mark[found] = False
    return found.astype(np.int32)


class Model:
    """weights: scaled weight of each bucket; squares: squared scale of each bucket."""

    def __init__(self, weights, squares, bias: float, slope: float, offset: float):
        self.weights, self.squares, self.bias, self.slope, self.offset = weights, squares, bias, slope, offset

    def margin(self, buckets: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[buckets].sum()))
        return float(self.weights[buckets].sum()) / norm + self.bias if norm > 0 else self.bias

    def score(self, buckets: np.ndarray) -> float:
        z = self.slope * self.margin(buckets) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the intercept is a constant feature of 1."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    values = [(v / n if (n := np.sqrt((v * v).sum())) > 0 else v).astype(np.float32) for v in (scale[i] for i in rows)]
    sq = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / sq[i], 0.0), cost)
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3 * cost:
            break
    return w, bias


def _log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << BITS))
    for r, side in zip(rows, y):
        counts[int(side > 0)][r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve: slope and offset of the log-odds, with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    theta, x = np.zeros(2), np.column_stack((margins, np.ones(len(margins))))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, good_share: float, cost: float = 1.0, rounds: int = 30) -> Model:
    """y: +1 or -1 for each row of buckets. Rows are in hash order, so every fifth one is a fair hold-out."""
    prior = float(np.log(max(good_share, 1e-6) / max(1 - good_share, 1e-6)))
    held = np.arange(len(rows)) % 5 == 0
    if min((y[~held] > 0).sum(), (y[~held] < 0).sum(), (y[held] > 0).sum(), (y[held] < 0).sum()) == 0:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, prior)

    def part(keep: np.ndarray) -> Model:
        own, side = [rows[i] for i in np.flatnonzero(keep)], y[keep]
        ratio = _log_ratio(own, side)
        w, bias = _descend(own, side, ratio, cost, rounds)
        return Model(w * ratio, ratio * ratio, bias, 1.0, 0.0)

    trial = part(~held)
    slope, offset = _logistic(np.array([trial.margin(rows[i]) for i in np.flatnonzero(held)]), y[held])
    model = part(np.ones(len(rows), bool))
    shift = prior - float(np.log((y > 0).sum() / (y < 0).sum()))
    model.slope, model.offset = slope, offset + shift
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality), without the held-out fifth."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.5
    picks = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = picks[0].union(picks[1])  # 2 * per_class rows at most, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = np.zeros(1 << BITS, bool)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "quality": rows["quality"], "buckets": [features(x, mark).tobytes() for x in rows["text"]]})

    made = texts.mapInPandas(run, "doc_id long, quality int, buckets binary")
    made = written(made.select(F.xxhash64("doc_id").alias("h"), "quality", "buckets"), "sample")
    sizes = sorted((r["quality"], r["h"], r["n"]) for r in made.select("quality", "h", F.octet_length("buckets").alias("n")).collect())
    fits = [F.lit(False)]
    for quality in (0, 1):
        own = [(h, n) for q, h, n in sizes if q == quality]
        taken = np.searchsorted(np.cumsum([n for _, n in own]), sample_bytes / 2, "right") if own else 0
        if taken:
            fits.append((F.col("quality") == quality) & (F.col("h") <= own[taken - 1][0]))
    got = made.where(reduce(or_, fits)).collect()
    got.sort(key=lambda r: (r["h"], r["quality"]))
    rows = [np.frombuffer(r["buckets"], np.int32) for r in got]  # no copies
    return fit(rows, np.array([1 if r["quality"] else -1 for r in got]), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with one more double column, quality_score or, where docs has that, free_name(docs, "quality_score")."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.squares.astype(np.float32), model.bias, model.slope, model.offset))

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, mark = Model(*shared.value), np.zeros(1 << BITS, bool)
        for texts in batches:
            yield pd.Series([own.score(features(x, mark)) for x in texts], dtype="float64")

    scored = F.pandas_udf(scores, "double")
    return docs.withColumn(free_name(docs, "quality_score"), scored(F.col("text").cast("string")))


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
