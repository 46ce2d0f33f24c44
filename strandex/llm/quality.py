"""Quality scores by positive-unlabelled learning: non-negative unbiased risk over surface features of whole texts."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandex.llm.common import packed, table, unpacked

#: Bounds of the sample that the model is fitted on: trusted positives, unlabelled texts, labelled rows to calibrate by.
POSITIVES, UNLABELLED, CALIBRATION = 12_000, 24_000, 8_000
THRESHOLD = 0.7
SEED = 11
HIDDEN, EPOCHS, STEPS, BATCH, RATE = 12, 40, 800, 2048, 0.01

_BYTE = np.arange(256)
_CLASSES = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "space": np.isin(_BYTE, [9, 10, 11, 12, 13, 32]),
    "stop": np.isin(_BYTE, list(b".,;:'\"()-?")),
    "bang": _BYTE == 33,
    "wide": _BYTE >= 128,
}
_CLASSES["symbol"] = ~sum(_CLASSES.values()).astype(bool)
_TABLE = np.array(list(_CLASSES.values()), dtype=np.float64).T


def features(text: str | None) -> list[float]:
    """Shares and rates that hold for texts of any length; an empty text (null, blank) has only its own flag."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    kinds = np.bincount(raw, minlength=256) @ _TABLE
    shares = kinds / len(raw)
    letters = max(1.0, kinds[0] + kinds[1])
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    pairs = n - 1
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    alone = sum(1 for w in counts if not any(map(str.isalnum, w)))
    grams = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    return [
        *shares,
        kinds[0] / letters,
        np.log1p(n) / 10,
        len(counts) / n,
        top / n if n > 4 else 0.0,
        sum(map(operator.eq, words, words[1:])) / pairs if pairs else 0.0,
        grams,
        sum(counts[w] for w in counts if not any(map(str.isalnum, w))) / n if alone else 0.0,
        lengths.mean() / 10,
        lengths.std() / 10,
        min(float(lengths.max()), 200.0) / 100,
        1 - len(set(lines)) / len(lines),
        n / len(lines) / 100 if n < 100 * len(lines) else 1.0,
        sum(w[0].isupper() for w in counts) / len(counts),
        0.0,
    ]


N_FEATURES = len(_CLASSES) + 14


@dataclass(frozen=True)
class Model:
    """A net of one hidden layer, with the scaling of its input and the calibration of its output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.shift, -35, 35)))


def _net(x: np.ndarray, y: np.ndarray, risk, rounds: int, seed: int) -> Model:
    """Adam on the gradient that ``risk(logits, y)`` gives for the logits of a batch."""
    rnd = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    params = [rnd.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, rounds = 0, max(rounds, STEPS * BATCH // (len(z) + BATCH))  # a small sample is seen more often
    for _ in range(rounds):
        order = rnd.permutation(len(z))
        for at in range(0, len(z), BATCH):
            part = order[at : at + BATCH]
            if len(part) < min(len(z), 64):
                continue
            w1, b1, w2, b2 = params
            h = np.tanh(z[part] @ w1 + b1)
            g = risk(h @ w2 + b2[0], y[part])
            dh = np.outer(g, w2) * (1 - h * h)
            t += 1
            for i, grad in enumerate((z[part].T @ dh + 1e-4 * w1, dh.sum(axis=0), h.T @ g + 1e-4 * w2, g.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                params[i] = params[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    w1, b1, w2, b2 = params
    return Model(mean, scale, w1, b1, w2, float(b2[0]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _plain(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (_sigmoid(logits) - y) / len(y)


def _nonnegative(prior: float):
    """Gradient of prior * E_P[l(f, +)] + max(0, E_U[l(f, -)] - prior * E_P[l(f, -)]) for the logistic loss.

    Where the second part is negative it is an artefact of fitting the sample, and the step goes against it.
    """

    def risk(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = y == 1
        n_p, n_u = max(1, p.sum()), max(1, (~p).sum())
        s = _sigmoid(logits)
        minus = np.logaddexp(0, logits)
        rest = minus[~p].sum() / n_u - prior * minus[p].sum() / n_p
        g = np.where(p, -prior * s / n_p, s / n_u)
        if rest < 0:
            return -g
        return g + np.where(p, prior * (s - 1) / n_p, 0.0)

    return risk


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the unlabelled scores allow: the least ratio, over the upper tails of the
    scores, of the share of unlabelled to that of positive texts, each with the error of a sample of its size."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.7, 35))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(u * (1 - u) / max(1, len(unlabelled))) + np.sqrt(p * (1 - p) / max(1, len(positive)))
    return float(np.clip(((u + error) / np.maximum(p, 0.05)).min(), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, known: np.ndarray | None = None, truth: np.ndarray | None = None, seed: int = SEED) -> Model:
    """The model from features of trusted positives and of unlabelled texts.

    ``known, truth``: features and labels of rows whose labels may be learned; where both labels occur, they estimate
    the class prior and set slope and shift of the scores. Else the prior is estimated by :func:`class_prior`.
    Without positives or without unlabelled texts every score is 0.5.
    """
    if not len(positive) or not len(unlabelled):
        z = np.zeros(N_FEATURES)
        return Model(z, z + 1, np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    x = np.vstack([positive, unlabelled])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    both = truth is not None and 0 < truth.sum() < len(truth)
    if both:
        prior = float(np.clip(truth.mean(), 0.05, 0.98))
    else:
        rough = _net(x, y, _plain, EPOCHS // 2, seed)
        prior = class_prior(rough.logit(positive), rough.logit(unlabelled))
    model = _net(x, y, _nonnegative(prior), EPOCHS, seed)
    slope, shift = 1.0, 0.0
    if both:
        z = np.clip(model.logit(known), -30, 30)
        slope, shift = 0.5, 0.0
        for _ in range(200):
            p = _sigmoid(slope * z + shift)
            w = p * (1 - p) + 1e-6
            g = np.array([((p - truth) * z).sum() + 1e-2 * (slope - 0.5), (p - truth).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.linalg.solve(hess, g)
            slope, shift = slope - 0.5 * step[0], shift - 0.5 * step[1]
    return Model(model.mean, model.scale, model.w1, model.b1, model.w2, model.b2, max(float(slope), 0.05), float(shift), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _matrix(docs: DataFrame) -> np.ndarray:
    """The features of a bounded sample, on the driver, in an order of their own: the fit doesn't hang on partitions."""
    rows = docs.select("text").mapInArrow(_extract, "x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    return x[np.lexsort(x.T)]


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))], names=["x"])


def _some(rows: DataFrame, n: int, salt: str) -> DataFrame:
    """At most n rows by a hash of their ids: the same ones whatever the partitioning."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """Fits on rows that aren't held out: positives are those with quality 1, unlabelled texts are drawn from all.

    ``labels(doc_id, quality)``; null and other values are ignored. The sample is bounded by POSITIVES, UNLABELLED
    and CALIBRATION, whatever the size of the corpus.
    """
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).where(~held_out(F.col("doc_id")))
    known = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    trusted = _some(known.where("quality = 1").select("doc_id"), POSITIVES, "p").distinct()
    positive = _matrix(texts.join(F.broadcast(trusted), "doc_id", "left_semi"))
    unlabelled = _matrix(texts.join(F.broadcast(_some(texts.select("doc_id"), UNLABELLED, "u").distinct()), "doc_id", "left_semi"))
    judged = texts.join(F.broadcast(_some(known, CALIBRATION, "c").dropDuplicates(["doc_id"])), "doc_id")
    rows = judged.select("text", "quality").mapInArrow(_extract_judged, "x array<double>, y int").toPandas()
    known_x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    truth = rows["y"].to_numpy(dtype=np.float64)
    order = np.lexsort((truth, *known_x.T))
    return fit(positive, unlabelled, known_x[order], truth[order], seed)


def _extract_judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([x, batch.column(1).cast(pa.int32())], names=["x", "y"])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1] of each whole text; null text scores as an empty one. No shuffle."""

    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, N_FEATURES)))

    return docs.withColumn(out, F.pandas_udf(judge, "double")(F.col(text_col)))


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of at least 0.7 stay; the others go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return unpacked(score(packed(docs, "text"), model).where(F.col("score") >= THRESHOLD), docs)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
