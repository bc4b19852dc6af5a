"""Toxicity as an ordinal severity: cumulative-link regression on sparse text features.

P(grade >= k) = logistic(w . x - t_k): one weight per word, shared by all ordered thresholds t_1 < t_2 < ..., so the
expected severity is the sum of these probabilities. x holds the presence of words and word beginnings of a vocabulary
that is chosen by its association with the labels. Where labels are only toxic or not, ``grades`` orders the toxic ones by how many
distinct strongly associated words they hold.

The classifier is fitted on at most ``max_labelled`` labelled rows, taken in the order of a hash of their id; the
vocabulary has at most ``max_words`` words. Scoring reads whole texts of all documents.

Defined results: a null or empty text has only the intercepts' severity; repeated rows are judged alike; with no
labels of either kind nothing is toxic; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The text's distinct words and, marked by a star, their first 4 and 5 letters: a stem shows whatever its ending."""
    words = set(WORD.findall((text or "").lower()))
    return words.union([w[:4] + "*" for w in words if len(w) > 4], [w[:5] + "*" for w in words if len(w) > 5])


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]
    #: Probability of grade 1 or more from which a text counts as toxic.
    cut: float = 0.5

    def severity(self, words: set[str]) -> tuple[float, float]:
        """Expected grade, and the probability of grade 1 or more."""
        z = sum(self.weights[w] for w in sorted(self.weights.keys() & words))
        p = [1.0 / (1.0 + np.exp(-np.clip(z - t, -40.0, 40.0))) for t in self.thresholds]
        return float(sum(p)), float(p[0]) if p else 0.0


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 0.02, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the whole likelihood. ``rows``: indices of the features present."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate(rows).astype(np.int64) if len(owner) else np.empty(0, np.int64)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.05))  # thresholds are the first one plus positive gaps
    x = np.concatenate([np.zeros(n_features), first[:1], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = len(rows)
    for step in range(1, steps + 1):
        w, gap = x[:n_features], np.exp(x[n_features + 1 :])
        t = x[n_features] + np.concatenate([[0.0], np.cumsum(gap)])
        z = np.bincount(owner, w[index], n) if len(index) else np.zeros(n)
        s = 1.0 / (1.0 + np.exp(-np.clip(z[None, :] - t[:, None], -40, 40)))
        upper = np.vstack([np.ones(n), s, np.zeros(n)])  # P(grade >= k)
        d = np.vstack([np.zeros(n), s * (1 - s), np.zeros(n)])
        k = grades
        mass = np.maximum(upper[k, np.arange(n)] - upper[k + 1, np.arange(n)], 1e-12)
        up, down = d[k, np.arange(n)] / mass, d[k + 1, np.arange(n)] / mass
        gz = -(up - down) / n
        gt = np.array([np.sum(np.where(k == j, up, 0.0) - np.where(k == j - 1, down, 0.0)) for j in range(1, n_grades)]) / n
        gw = (np.bincount(index, gz[owner], n_features) if len(index) else np.zeros(n_features)) + l2 * w / max(n_features, 1)
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, tail[:1], tail[1:] * gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_features + 1 :]))])


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score in the middle of the gap that splits the fitted rows with the best F1."""
    order = np.argsort(-score, kind="stable")
    ranked, hits = score[order], np.cumsum(toxic[order])
    last = np.append(ranked[1:] != ranked[:-1], True)  # a cut lies below all rows of one score
    f1 = np.where(last, 2 * hits / (np.arange(1, len(score) + 1) + toxic.sum()), -1.0)
    k = int(f1.argmax())
    return float((ranked[k] + ranked[k + 1]) / 2) if k + 1 < len(score) else float(ranked[k] - 1e-9)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([sorted(words_of(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), words], ["toxic", "words"])


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_words: int = 2_048, n_grades: int = 4, min_rows: int = 6, min_z: float = 5.0) -> Model:
    """``documents``: doc_id, text; ``labels``: doc_id and toxic, 0 or 1."""
    small_batches(documents.sparkSession)
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    rows = written(picked.mapInArrow(_words, "toxic int, words array<string>"), "toxicity-words")
    totals = rows.agg(F.count("*"), F.sum("toxic")).first()
    n, positive = totals[0], totals[1] or 0
    if not positive or positive == n:
        return Model({}, [])
    counted = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    base = positive / n
    z = (F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    top = counted.where(F.col("n") >= min_rows).withColumn("z", z).where(F.abs("z") >= min_z).orderBy(F.desc(F.abs("z")), "word").limit(max_words).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(top)}
    strong = {i for i, r in enumerate(top) if r["z"] > 0 and (r["p"] + 1) / (r["n"] + 2) >= 0.7}
    known = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")) if vocabulary else F.array().cast("array<string>")
    data = rows.select("toxic", known.alias("words")).collect()
    features = [np.array([vocabulary[w] for w in r["words"]], np.int64) for r in data]
    # Without graded labels a toxic text's grade follows its number of strong words, cut at their quantiles.
    hits = np.array([sum(i in strong for i in f.tolist()) for f in features])
    toxic = np.array([r["toxic"] for r in data])
    cuts = np.quantile(hits[toxic == 1], np.linspace(0, 1, n_grades)[1:-1])
    grades = np.where(toxic == 1, 1 + (hits[:, None] > cuts[None, :]).sum(axis=1), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # no grade without rows
    weights, thresholds = fit_cumulative_link(features, grades, len(vocabulary), int(grades.max()) + 1)
    z = np.array([weights[f].sum() for f in features])
    cut = 1.0 / (1.0 + np.exp(-np.clip(best_cut(z, toxic) - thresholds[0], -40.0, 40.0)))
    return Model({w: float(weights[i]) for w, i in vocabulary.items()}, [float(t) for t in thresholds], float(cut))


def _score(sent, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            got = [model.severity(words_of(t)) for t in batch.column(1).to_pylist()]
            severity, p = [g[0] for g in got], [g[1] for g in got]
            columns = [batch.column(0), pa.array(severity, pa.float64()), pa.array([int(s + 0.5) for s in severity], pa.int32()), pa.array([x >= cut for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "severity", "grade", "toxic"])
        tidy()

    return run


def score(documents: DataFrame, model: Model, cut: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key (its ``doc_id``), expected severity, grade, toxic (grade 1 or more as likely as ``cut``, by default the model's own)."""
    cut = model.cut if cut is None else cut
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_score(sent, cut), "key long, severity double, grade int, toxic boolean")


def _keep(sent, cut: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.severity(words_of(t))[1] < cut for t in batch.column(at).to_pylist()], pa.bool_()))
        tidy()

    return run


def drop_toxic(documents: DataFrame, model: Model, cut: float | None = None, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that are not toxic, in one pass, all columns as they are."""
    cut = model.cut if cut is None else cut
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_keep(sent, cut, documents.columns.index(text)), documents.schema)
