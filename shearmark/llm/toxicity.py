"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold[k] - w . x) with one weight vector for all ordered thresholds; x says which words
and word beginnings of the vocabulary a text has.  The severity of a text is its expected grade, the sum of P(grade > k).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import settle

FIT_ROWS = 20_000
BEGINNINGS = (4, 5, 6)
KNOWN_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The word and its beginnings (marked by a star), which catch its inflections."""
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


@dataclass
class Model:
    """Weights by word and the ordered thresholds; without thresholds every text has severity 0."""

    weights: dict[str, float]
    thresholds: list[float]
    cut: float = 0.0

    def severity(self, text: str | None, known: dict[str, tuple[str, ...]]) -> float:
        """Expected grade; ``known`` keeps the features of words over texts."""
        found: set[str] = set()
        for word in words_of(text):
            hits = known.get(word)
            if hits is None:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                hits = known[word] = tuple(f for f in features_of(word) if f in self.weights)
            found.update(hits)
        score = math.fsum(self.weights[f] for f in found)
        return self.expected(score)

    def expected(self, score: float) -> float:
        return sum(1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds)

    def limit(self) -> float:
        """Severity above which a text is toxic."""
        return self.expected(self.cut) if self.thresholds else math.inf


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score between two neighbours that gives the best balanced accuracy; of equals, the widest gap."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], toxic[order].astype(float)
    gain = np.cumsum((1 - y) / max(1, (1 - y).sum()) - y / max(1, y.sum()))
    gap = np.r_[np.diff(s), 0.0]
    gain[gap == 0] = -np.inf
    if not np.isfinite(gain).any():
        return float(s[-1])
    best = np.flatnonzero(np.isclose(gain, gain.max()))
    at = best[np.argmax(gap[best])]
    return float((s[at] + s[at + 1]) / 2)


@dataclass
class Sparse:
    """Rows of 0 and 1 by the places of their ones."""

    row: np.ndarray
    column: np.ndarray
    shape: tuple[int, int]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.column], minlength=self.shape[0])

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=values[self.row], minlength=self.shape[1])


def cumulative_link(x: Sparse, grade: np.ndarray, grades: int, steps: int = 300, ridge: float = 1e-4,
                    rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised negative log-likelihood, by Adam; deterministic."""
    n, d = x.shape
    share = np.clip(np.array([(grade <= k).mean() for k in range(grades - 1)]), 1e-4, 1 - 1e-4)
    theta = np.r_[np.zeros(d), np.log(share / (1 - share))]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        score, cut = x.times(theta[:d]), np.r_[-np.inf, theta[d:], np.inf]
        upper = np.where(grade == grades - 1, 1.0, sigmoid(cut[grade + 1] - score))
        lower = np.where(grade == 0, 0.0, sigmoid(cut[grade] - score))
        p = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = np.r_[x.back(up - low) / n + ridge * theta[:d],
                      [((grade == k + 1) * low).sum() / n - ((grade == k) * up).sum() / n for k in range(grades - 1)]]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[d:] = np.maximum.accumulate(theta[d:])
    return theta[:d], theta[d:]


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, label and features (words) of at most ``fit_rows`` labelled keys, those of smallest hash.

    The rows chosen are few and bounded, so they are broadcast and the documents stay where they are.
    """
    chosen = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)

    def split(batches):
        for batch in batches:
            for part in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
                found = [sorted({f for w in words_of(t) for f in features_of(w)}) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), part.column("label"), pa.array(found, pa.list_(pa.string()))], names=["_key", "label", "words"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    kind = rows.schema["_key"].dataType.simpleString()
    rows = rows.select("_key", "label", "_text").mapInArrow(split, f"_key {kind}, label int, words array<string>")
    # a key is one row of the sample however often it is among the documents
    return settle(rows.groupBy("_key").agg(F.max("label").alias("label"), F.max("words").alias("words")), "labelled")


def fit(rows: DataFrame, strength: float = 5.0) -> Model:
    """Model from the bounded ``sample``.

    The vocabulary is every feature whose shares of toxic and of clean texts lie at least ``strength`` standard errors
    apart.  Labels only say toxic or not; toxic texts are graded 1 or 2 by whether
    their number of toxic features is below or above the middle of all toxic texts.  Without toxic or without
    clean texts the model is empty.
    """
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not toxic or not clean:
        return Model({}, [])
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    share = (F.col("a") + F.col("b")) / F.lit(toxic + clean)
    error = F.sqrt(share * (1 - share) * F.lit(1 / toxic + 1 / clean))
    ranked = counts.withColumn("z", F.try_divide(F.col("a") / F.lit(toxic) - F.col("b") / F.lit(clean), error)).filter(
        F.abs("z") >= strength)
    picked = [(r["word"], r["z"]) for r in ranked.orderBy("word").collect()]  # features of at most fit_rows rows
    if not picked:
        return Model({}, [])
    vocabulary = settle(rows.sparkSession.createDataFrame([(w,) for w, _ in picked], "word string"), "vocabulary")
    # the features that fit_rows rows have of it
    cells = rows.select("_key", "label", F.explode_outer("words").alias("word")).join(
        vocabulary.withColumn("known", F.lit(True)), "word", "left").groupBy("_key", "label").agg(
        F.collect_set(F.when(F.col("known"), F.col("word"))).alias("words")).orderBy("_key").collect()
    place = {w: n for n, (w, _) in enumerate(picked)}
    x = Sparse(np.repeat(np.arange(len(cells)), [len(r["words"]) for r in cells]),
               np.array([place[w] for r in cells for w in sorted(r["words"])], dtype=np.int64), (len(cells), len(place)))
    label = np.array([r["label"] for r in cells])
    marks = x.times(np.array([z > 0 for _, z in picked], dtype=float))
    middle = np.median(marks[label == 1])
    grade = np.where(label == 0, 0, np.where(marks > middle, 2, 1))
    weights, thresholds = cumulative_link(x, grade, 3)
    cut = best_cut(x.times(weights), label == 1)
    return Model(dict(zip(place, weights.tolist(), strict=True)), thresholds.tolist(), cut)


def severity(model: Model, text: str) -> Column:
    """Expected grade of a text column; null and empty texts have that of no words."""
    known: dict[str, tuple[str, ...]] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array([model.severity(t.as_py(), known) for t in texts], pa.float64())
        pa.default_memory_pool().release_unused()
        return out

    return score(F.col(text))


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity and toxic (severity above the cut of best balanced accuracy on the sample) of every row.

    The fit sees at most ``fit_rows`` labelled rows, scoring all rows and whole texts.  Repeated rows repeat, null keys
    are scored, other columns are not read, an empty table gives no rows.
    """
    model = fit(sample(docs, labels, fit_rows, key, text))
    out = docs.select(F.col(key).alias(key), severity(model, text).alias("severity"))
    return out.withColumn("toxic", F.col("severity") > F.lit(model.limit()))


def clean_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """The rows that are not toxic, with the columns of ``docs`` whatever their names."""
    model = fit(sample(docs, labels, fit_rows, key, text))
    if not model.thresholds:
        return docs
    return docs.filter(severity(model, text) <= F.lit(model.limit()))
