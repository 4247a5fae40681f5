"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows; the unlabelled class is web text as it comes, good and bad. With class
prior p the negative risk of the unlabelled rows, less the part that positives contribute to it, is never let
below zero: where it would be, the step undoes that part instead (Kiryo et al., 2017). The prior is estimated from
the positives and the unlabelled text alone: a classifier of one against the other is learnt on half of them, and on
the other half the share of unlabelled text above a threshold, over that of positives, bounds the prior; the
threshold where the bound is tightest gives it (best bin estimation, Garg et al., 2021). The model is logistic
over piecewise linear functions of standardised text statistics, so its sigmoid is a posterior probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import as_bytes, carried, need, row_schema, slices, table

#: Bounds of the sample that the fit sees (documents of each kind, chosen by a hash of id and text).
MOST_POSITIVE = 20_000
MOST_UNLABELLED = 20_000
FOLDS = 5
THRESHOLD = 0.3
STEPS = 800
RATE = 0.05
DECAY = 1e-4
SLICE_BYTES = 4_000_000
#: Of best bin estimation: confidence, and weight of the positives' error.
DELTA, GAMMA = 0.1, 0.01

_RANGES = (
    (0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39), (0x20, 0x20), (0x0A, 0x0A), (0x80, 0xFF), (0x21, 0x2F), (0x3A, 0x40),
    (0x5B, 0x60), (0x7B, 0x7E), (0x21, 0x21), (0x2E, 0x2E), (0x2C, 0x2C), (0x23, 0x26), (0x2A, 0x2A), (0x00, 0x09),
)
_CLASSES = np.zeros((256, len(_RANGES)))
for _k, (_a, _b) in enumerate(_RANGES):
    _CLASSES[_a : _b + 1, _k] = 1.0
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
N_FEATURES = len(_RANGES) + 12


def features(text: bytes | None) -> np.ndarray:
    """Statistics of a whole text: shares of character classes, word and line lengths, repetition."""
    data = text or b""
    words, lines = data.split(), data.split(b"\n")
    n_words = len(words)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n_words) if n_words else np.zeros(1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    caps = sum(w.isupper() for w in seen)
    return np.concatenate(
        [
            counts @ _CLASSES / max(1, len(data)),
            [
                len(seen) / max(1, n_words),
                pairs / max(1, n_words - 1),
                len(set(lines)) / len(lines),
                (max(seen.values()) if seen else 0) / max(1, n_words),
                caps / max(1, len(seen)),
                sum(map(eq, words, words[1:])) / max(1, n_words - 1),
                sum(n for w, n in seen.items() if not w.strip(_PUNCTUATION)) / max(1, n_words),
                np.log1p(n_words),
                np.log1p(len(lines)),
                lengths.mean(),
                lengths.std(),
                np.log1p(len(data)) - np.log1p(len(lines)),
            ],
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """Each standardised statistic, and what it has beyond one deviation to either side: extremes extend linearly."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0), np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def _minimised(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float, decay: float) -> np.ndarray:
    """Weights after ``steps`` of Adam from zero."""
    w, m, v = np.zeros((3, size))
    for t in range(1, steps + 1):
        grad = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _standard(x: np.ndarray, prior: float) -> Model:
    return Model(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(3 * N_FEATURES + 1), prior)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk of weights on designs: that of positives, and the negative one before it is cut at zero."""
    gp, gu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Minimise prior x E_p[l(g)] + max(0, E_u[l(-g)] - prior x E_p[l(-g)]), l the logistic loss."""
    model = _standard(np.concatenate([positive, unlabelled]), prior)
    p, u = model.design(positive), model.design(unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return prior * (p.T @ (sp - 1)) / len(p) + down if risk(w, p, u, prior)[1] >= 0 else -down

    return replace(model, weights=_minimised(gradient, p.shape[1], steps, rate, decay))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> float:
    """Share of positives in the unlabelled rows, by best bin estimation; needs no negative. Rows come in an order of no meaning."""
    model = _standard(np.concatenate([positive, unlabelled]), 0.5)
    p, u = model.design(positive[::2]), model.design(unlabelled[::2])

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        return p.T @ (sp - 1) / len(p) + u.T @ su / len(u)

    other = replace(model, weights=_minimised(gradient, p.shape[1], steps, rate, decay))
    own, web = np.sort(other.score(positive[1::2])), np.sort(other.score(unlabelled[1::2]))
    if not len(own) or not len(web):
        return 0.5
    at = np.unique(own)
    above_own = 1 - np.searchsorted(own, at) / len(own)
    above_web = 1 - np.searchsorted(web, at) / len(web)
    error = np.sqrt(np.log(4 / DELTA) / (2 * len(web))) + (1 + GAMMA) * np.sqrt(np.log(4 / DELTA) / (2 * len(own)))
    best = np.argmin((above_web + error) / above_own)
    return float(min(0.95, max(0.05, above_web[best] / above_own[best])))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves no rest by FOLDS; a null id counts as empty text and is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def _features(trusted: np.ndarray, plain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = np.asarray(batch.column("draw"))
            asked = np.flatnonzero(np.isin(draw, trusted) | np.isin(draw, plain))
            for part in slices([batch.take(pa.array(asked))] if len(asked) else [], "text", SLICE_BYTES):
                rows = [features(t).tolist() for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("draw"), pa.array(rows, pa.list_(pa.float64()))], names=["draw", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """Fit on at most ``most_positive`` trusted and ``most_unlabelled`` plain documents outside the held-out fold.

    Trusted: labelled 1 and never 0. Rows that repeat id and text are one document, so no more than the two bounds
    reach the driver, as statistics. Labels 0 teach nothing. None where there is no positive or nothing else.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "quality")
    marks = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("q"))
    drawn = docs.filter(~held_out()).select("doc_id", F.xxhash64(F.lit(9), "doc_id", "text").alias("draw"), "text")
    names = drawn.select("doc_id", "draw")

    def chosen(rows: DataFrame, most: int) -> np.ndarray:
        return np.array([r[0] for r in rows.select("draw").distinct().orderBy("draw").limit(most).collect()], dtype=np.int64)

    trusted = chosen(names.join(marks.filter("q = 1").select("doc_id"), "doc_id", "left_semi"), most_positive)
    plain = chosen(names, most_unlabelled)
    if not len(trusted) or not len(np.setdiff1d(plain, trusted)):
        return None
    found = drawn.select("draw", "text").mapInArrow(_features(trusted, plain), "draw long, x array<double>").groupBy("draw").agg(F.first("x").alias("x")).orderBy("draw").toArrow()
    draw, x = np.asarray(found.column("draw").combine_chunks()), np.array(found.column("x").to_pylist())
    positive, unlabelled = x[np.isin(draw, trusted)], x[np.isin(draw, plain)]
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def _scores(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            x = np.array([features(t) for t in as_bytes(batch.column("text"))])
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    return run


def classify(docs: DataFrame, model: Model | None, keep_text: bool = False) -> DataFrame:
    """(row, score): row is the struct of all columns (but text, unless ``keep_text``).

    Only the text makes the score. Null and empty texts are scored as texts without characters; very long ones whole;
    repeated rows alike. Without a model (no positive labels) every score is 0.5. An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    own = docs.select(carried(docs, *(() if keep_text else ("text",))), "text")
    return own.mapInArrow(_scores(model), row_schema(own, "score double"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select(
        "row.doc_id",
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
