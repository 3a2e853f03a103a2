"""Quality classifier by positive-unlabelled learning.

Every text gets a few figures of form (shares of kinds of characters, repeated words, lengths). Trusted
positives and unlabelled web text give the non-negative unbiased risk of a logistic model,

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

minimised by gradient steps; where the second term falls below zero the step goes against it, so
the model can't gain from overfitting the positives. Labels of 0 serve only the estimate of the class prior.

The risk is taken over bounded samples of ``sample`` positives and ``sample`` unlabelled texts, those
with the smallest hashes; every text is read for its figures and scored.

Null and empty texts have all figures 0 and a score like any other. Rows without doc_id aren't
learned from. Without positives all scores are the prior. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import remainder, slices, utf8

FIGURES = [
    "length", "letters", "capitals", "digits", "symbols", "calls", "bars", "spaces", "lines", "stops", "word",
    "again", "distinct", "odd_ends", "commonest_symbol",
]

_BYTES = np.arange(256)


def _is(chars: bytes) -> np.ndarray:
    return np.isin(_BYTES, np.frombuffer(chars, np.uint8)).astype(np.float64)


_UPPER = _is(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _is(b"abcdefghijklmnopqrstuvwxyz") + (_BYTES >= 0xC2)
_SYMBOL_CHARS = b"#$%&*+/<=>@[\\]^_`{|}~"
_KINDS = np.stack(
    [_LETTER, _UPPER, _is(b"0123456789"), _is(_SYMBOL_CHARS), _is(b"!?"), _is(b"|"), _is(b" \t\r\n\v\f"), _is(b"\n"), _is(b".,;:")]
)
_ODD_ENDS = frozenset(_SYMBOL_CHARS + b"!?")
_SYMBOLS = np.frombuffer(_SYMBOL_CHARS, np.uint8)


def figures(text: bytes) -> np.ndarray:
    """The figures of one text; shares as square roots, so that small shares tell."""
    out = np.zeros(len(FIGURES))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = _KINDS @ counts
    n = kinds[0] + counts[0:0x80].sum() - (_LETTER * counts)[:0x80].sum()  # characters, nearly
    words = text.split()
    k = max(1, len(words))
    out[0] = np.log1p(len(words)) / 10
    out[1:10] = kinds / max(1.0, n)
    out[2] = kinds[1] / max(1.0, kinds[0])
    out[10] = min(kinds[0] / k, 50) / 50
    out[11] = sum(map(eq, words, words[1:])) / k
    out[12] = len(set(words)) / k ** 0.9
    out[13] = sum(w[-1] in _ODD_ENDS for w in words) / k
    out[14] = counts[_SYMBOLS].max() / k
    return np.sqrt(np.minimum(out, 4))


def with_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the figures of every text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            x = np.stack([figures(t) for t in texts]) if texts else np.zeros((0, len(FIGURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return rows.mapInArrow(run, "doc_id bigint, x array<double>")


def fit_risk(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, penalty: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by full gradient steps (Adam)."""
    both = np.concatenate([positive, unlabelled])
    mean, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.hstack([np.clip((x - mean) / spread, -6, 6), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w, m, v = np.zeros(both.shape[1] + 1), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) for x in (p, u))
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        grad_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if negative >= 0:
            grad = prior * (p.T @ (sp - 1)) / len(p) + grad_negative
        else:
            grad = -grad_negative
        grad = grad + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1] / spread, float(w[-1] - (w[:-1] / spread) @ mean)


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """Figures of the ``size`` rows with the smallest hashes of doc_id."""
    least = rows.select("x", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).orderBy("doc_id").select("x").toPandas()["x"]
    return np.stack(least.to_list()) if len(least) else np.zeros((0, len(FIGURES)))


def fit(known: DataFrame, labels: DataFrame, where: Column, sample: int = 20_000, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Weights over ``known`` (doc_id, x) from ``labels`` (doc_id, quality), both only with ``where``."""
    rated = labels.filter(where & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    rated = rated.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows = known.filter(where & F.col("doc_id").isNotNull())
    n, ones = rated.agg(F.count("quality"), F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0))).first()
    if prior is None:
        prior = (ones + 1) / (n + 2)
    prior = min(max(prior, 0.02), 0.98)
    positive = _sample(rows.join(rated.filter("quality = 1"), "doc_id", "left_semi"), sample)
    unlabelled = _sample(rows.join(rated, "doc_id", "left_anti"), sample)
    if not len(unlabelled):  # all are labelled: their texts without the labels
        unlabelled = _sample(rows, sample)
    if not len(positive) or not len(unlabelled):
        return np.zeros(len(FIGURES)), float(np.log(prior / (1 - prior)))
    return fit_risk(positive, unlabelled, prior)


def score(weights: np.ndarray, intercept: float) -> Column:
    """The probability of label 1 from column x."""
    total = F.lit(float(intercept))
    for i, w in enumerate(weights):
        total = total + F.col("x")[i] * float(w)
    return 1 / (1 + F.exp(-total))


def scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score): fold 0 of crc32(doc_id) is not learned from."""
    from txnrisk.sources.scratch import materialise

    known = materialise(with_figures(docs), "figures")
    weights, intercept = fit(known, labels, remainder(folds) != 0, sample)
    return known.select("doc_id", (remainder(folds) == 0).alias("held_out"), score(weights, intercept).alias("score"))
