"""Quality scores by positive-unlabelled learning (operator 3).

A logistic model is trained by minimising the non-negative PU risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``
with trusted positives (label 1), unlabelled web text, and a class prior that
is estimated from how a first positive-against-unlabelled model scores
positives it has not seen.  Training runs on the driver over a bounded sample;
features and scores are computed in the tasks over every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, column, held_out, pieces, read_table, text_bytes, unwrapped

by_value(__name__)

#: Rows of each kind (positives, unlabelled, labelled for calibration) that training fetches, at most.
TRAIN_ROWS = 6_000
LOWER, RIDGE = 0.9, 5e-3
#: Words of a window over which variety is measured, so that it does not fall with a text's length.
WINDOW = 100

_LETTERS = np.zeros(256, bool)
_LETTERS[np.r_[65:91, 97:123, 128:256]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)

FEATURES = 16 + len(_MARKS)


def features(text: bytes) -> np.ndarray:
    """Shape of a text, whatever its language: shares of kinds of characters
    and marks, word lengths, variety within windows, repeats.  An empty text
    has zeros."""
    out = np.zeros(FEATURES)
    words = text.split()
    if not words:
        return out
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, int(counts.sum()))
    letters = max(1, int(counts[_LETTERS].sum()))
    lengths = np.fromiter(map(len, words), np.float64, n)
    parts = [words[i : i + WINDOW] for i in range(0, n, WINDOW)]
    if len(parts) > 1 and len(parts[-1]) < WINDOW // 2:
        rest = parts.pop()
        parts[-1] = parts[-1] + rest
    # of the distinct words that w words of plain prose have (about w ** 0.88)
    variety = np.array([len(set(p)) / len(p) ** 0.88 for p in parts])
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    same += sum(a == b for a, b in zip(words, words[2:], strict=False)) / n
    lines = [x for x in text.split(b"\n") if x]
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    pairs = sum(len(w) > 2 and w[-1] == w[-2] and w[-1] < 128 and not w[-1:].isalnum() for w in words) / n
    out[:16] = (
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        np.minimum(variety, 1.5).mean(),
        np.minimum(variety, 1.5).min(),
        (variety < 0.5).mean(),
        same,
        np.sqrt(same),
        counts[_UPPER].sum() / letters,
        counts[_DIGITS].sum() / size,
        counts[_LETTERS].sum() / size,
        marked,
        pairs,
        np.sqrt(pairs),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    )
    out[16:] = np.sqrt(counts[_MARKS] / n)
    return out


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    slope: float
    shift: float
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return z @ self.weights[:-1] + self.weights[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(x) + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(start: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    """Adam; the mean of the second half of its steps, which settles where the
    non-negative correction makes single steps swing."""
    w, m, v, mean = start.copy(), np.zeros_like(start), np.zeros_like(start), np.zeros_like(start)
    half = steps // 2
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > half:
            mean += w / (steps - half)
    return mean


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled.  A logistic model g of positive
    against unlabelled is fitted to one half of each; on the other half
    mean g over unlabelled / mean g over positives, in odds, is that share where
    positives can be told apart (Elkan and Noto)."""
    a, b = positive[::2], unlabelled[::2]
    x = np.vstack([a, b])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.r_[np.ones(len(a)), np.zeros(len(b))]
    weight = np.r_[np.full(len(a), 0.5 / len(a)), np.full(len(b), 0.5 / len(b))]
    w = _descend(np.zeros(x.shape[1]), lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + 1e-4 * w, 300, 0.05)
    odds = lambda z: np.exp(np.clip(z[1::2] @ w[:-1] + w[-1], -6, 6))  # noqa: E731  density of positives / of unlabelled
    # positives have a ratio of 1 / prior; a high quantile of the ratio estimates it
    ratio = float(np.median(odds(positive)))
    return float(np.clip(1 / max(ratio, 1e-6), 0.05, 0.97))


def fit(positive: np.ndarray, unlabelled: np.ndarray, checked: np.ndarray, labels: np.ndarray, steps: int = 600) -> Model:
    """Non-negative PU learning, then one slope and shift so that scores are
    probabilities on the labelled rows ``checked`` (none, if they lack a class)."""
    both = np.vstack([positive, unlabelled])
    centre, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    shape = lambda x: np.hstack([np.clip((x - centre) / scale, -6, 6), np.ones((len(x), 1))])
    p, u = shape(positive), shape(unlabelled)
    # rather low than high: scores are calibrated below, while too high a prior lets the correction undo the rare negatives
    prior = LOWER * estimate_prior(p[:, :-1], u[:, :-1])

    def gradient(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        as_positive = -(p.T @ (1 - sp)) / len(p)
        negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        loss = lambda z: np.logaddexp(0, z)
        if loss(u @ w).mean() - prior * loss(p @ w).mean() < 0:  # below zero: undo it
            return -negative + RIDGE * w
        return prior * as_positive + negative + RIDGE * w

    w = _descend(np.zeros(p.shape[1]), gradient, steps, 0.05)
    model = Model(centre, scale, w, 1.0, 0.0, prior)
    if len(checked) and 0 < labels.mean() < 1:
        z = model.margins(checked)
        x = np.column_stack([z, np.ones(len(z))])
        slope, shift = _descend(np.array([1.0, 0.0]), lambda s: x.T @ (_sigmoid(x @ s) - labels) / len(x), 600, 0.05)
        model = Model(centre, scale, w, float(max(slope, 1e-3)), float(shift), prior)
    return model


def with_features(rows: DataFrame, text: str) -> DataFrame:
    """``text`` replaced by ``x``, an array of FEATURES doubles."""
    others = [c for c in rows.columns if c != text]
    schema = rows.select(*others, F.array(F.lit(0.0)).alias("x")).schema

    def run(batches):
        for piece in pieces(batches, text):
            raw, at = text_bytes(piece.column(piece.schema.get_field_index(text)))
            raw = raw.tobytes()
            x = np.concatenate([features(raw[at[i] : at[i + 1]]) for i in range(len(at) - 1)])
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * FEATURES), pa.array(x))
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in others), x], [*others, "x"])

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_ROWS) -> Model | None:
    """A model from trusted labels outside the held-out fold; None if no such
    label is positive.  Repeated labels of a document count as positive if all
    are; labels with a null are left out.  Of an id that several rows have, the
    smallest text counts.

    ``most`` bounds the rows of each kind that the driver fetches, positives,
    unlabelled and labelled for calibration, in the order of a hash of their
    ids.  The unlabelled ones also give the centre, the scale and the prior."""
    ids = F.col("id")
    known = (
        labels.select(column(labels, "doc_id").alias("id"), column(labels, "quality").alias("quality"))
        .filter(ids.isNotNull() & F.col("quality").isNotNull() & ~held_out(ids))
        .groupBy("id")
        .agg(F.min("quality").alias("quality"))
    )
    first = lambda df: df.orderBy(F.xxhash64("id"), "id").limit(most)
    every = docs.select(column(docs, doc_id).alias("id")).filter(ids.isNotNull()).distinct()
    wanted = (
        first(known.filter("quality = 1")).select("id", F.lit("positive").alias("kind"))
        .union(first(every).select("id", F.lit("unlabelled").alias("kind")))
        .union(first(known).select("id", F.when(ids.isNull(), "").when(F.col("quality") == 1, "good").otherwise("bad").alias("kind")))
    )
    # at most 3 * most ids, and one row of each, however many rows an id has
    rows = docs.select(column(docs, doc_id).alias("id"), column(docs, text).cast("string").alias("text")).join(F.broadcast(wanted), "id")
    rows = rows.groupBy("id", "kind").agg(F.min("text").alias("text"))
    got = with_features(rows.drop("id"), "text").toArrow()
    if not got.num_rows:
        return None
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
    kind = np.array(got.column("kind").to_pylist())
    order = np.lexsort([*x.T[::-1], kind])  # the same rows in the same order whatever the partitions
    x, kind = x[order], kind[order]
    mixed = np.random.default_rng(0).permutation(len(x))
    x, kind = x[mixed], kind[mixed]
    if (kind == "positive").sum() < 2 or (kind == "unlabelled").sum() < 2:
        return None
    labelled = (kind == "good") | (kind == "bad")
    return fit(x[kind == "positive"], x[kind == "unlabelled"], x[labelled], (kind[labelled] == "good").astype(float))


def with_scores(rows: DataFrame, text: str, model: Model | None, score: str = "score") -> DataFrame:
    """All columns of ``rows`` and ``score`` (0 to 1).  Without a model every
    score is 0.5.  Null is the empty text, which is scored too."""
    if model is None:
        return rows.withColumn(score, F.lit(0.5))
    schema = rows.withColumn(score, F.lit(0.0)).schema

    def run(batches):
        for piece in pieces(batches, text):
            raw, at = text_bytes(piece.column(piece.schema.get_field_index(text)))
            raw = raw.tobytes()
            x = np.stack([features(raw[at[i] : at[i + 1]]) for i in range(len(at) - 1)])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.scores(x))], [*piece.schema.names, score])

    return rows.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1
    if the score reaches ``threshold``).  Repeated rows and null ids are rows of
    their own; an empty table gives no rows."""
    model = train(docs, labels, text, doc_id)
    rows = docs.select(column(docs, doc_id).alias("id"), column(docs, text).cast("string").alias("text"))
    return with_scores(rows, "text", model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows predicted 0; all columns and their order stay.
    Without a trusted positive nothing can be judged and every row stays."""
    model = train(docs, labels, text, doc_id)
    if model is None:
        return docs
    packed = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("doc"), column(docs, text).cast("string").alias("text"))
    return unwrapped(with_scores(packed, "text", model).filter(F.col("score") >= threshold), docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
