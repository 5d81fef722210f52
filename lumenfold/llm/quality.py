"""Quality classifier: a support vector machine over naive-Bayes features.

Indicators of n-grams are scaled by the logarithm of the ratio of their smoothed class frequencies; a linear model with
hinge loss is fitted to them by dual coordinate descent. N-grams are words and word pairs (runs of letters), and shapes of
blank-separated tokens (character classes, runs collapsed) and of token pairs, with the share of the text that they make up;
a token that repeats the one before has the shape of a repeat. Scores are Platt-scaled on a part of the sample that the
machine didn't see.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BYTE_VALUES, LETTERS, NONSPACE, mix, powers, table, words
from .labelled import DIMENSIONS, Rows, fit_in_one_task, fold, platt, sample, scored, sigmoid

CUT = 0.3
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12
#: Percent of the sample that the scores are scaled on.
SCALED_ON = 20

_SHIFT = np.uint64(64 - DIMENSIONS.bit_length() + 1)
_U = np.uint64
#: Capital, small or other letter, digit; any other byte is a class of its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[48:58] = ord("0")


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each token's classes with runs collapsed."""
    c = _CLASS[data]
    new = np.ones(len(c), dtype=bool)
    new[1:] = c[1:] != c[:-1]
    new[starts] = True
    rank = np.zeros(len(c) + 1, dtype=np.int64)
    np.cumsum(new, out=rank[1:])
    p, inverse = powers(len(c) + 1)
    h = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum(np.where(new, BYTE_VALUES[c] * p[rank[:-1]], _U(0)), out=h[1:])
    return mix((h[ends] - h[starts]) * inverse[rank[starts]] + _U(77))


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct hashed n-grams of each text."""
    _, _, word, wb = words(data, offsets, LETTERS)
    pair = mix(word[:-1] * _U(3) + word[1:]) if len(word) else word
    starts, ends, token, tb = words(data, offsets, NONSPACE)
    shape = shapes(data, starts, ends) if len(starts) else token
    if len(token):
        again = np.zeros(len(token), dtype=bool)
        again[1:] = token[1:] == token[:-1]
        shape = np.where(again, _U(12345), shape)
    shape_pair = mix(shape[:-1] * _U(5) + shape[1:]) if len(shape) else shape
    out = []
    for i in range(len(offsets) - 1):
        a, b, c, d = wb[i], wb[i + 1], tb[i], tb[i + 1]
        parts = [word[a:b], pair[a : max(a, b - 1)]]
        for x in (shape[c:d], shape_pair[c : max(c, d - 1)]):
            name, count = np.unique(x, return_counts=True)
            share = np.minimum(6, np.floor(-np.log2(count / max(1, len(x))))).astype(np.uint64)
            parts += [mix(name + share + _U(1)), mix(name ^ _U(0xABCDEF))]
        out.append(np.unique(mix(np.concatenate(parts)) >> _SHIFT).astype(np.int64))
    return out


def log_ratio(rows: Rows, y: np.ndarray) -> np.ndarray:
    p = SMOOTHING + rows.back((y == 1).astype(float))
    q = SMOOTHING + rows.back((y == 0).astype(float))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights over indicators and bias of the hinge-loss machine: dual coordinate descent; rows are scaled to length one, classes weigh the same."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, COST * len(y) / 2 / max(1, (y == 1).sum()), COST * len(y) / 2 / max(1, (y == 0).sum()))
    values = [scale[r] / max(1e-12, np.linalg.norm(scale[r])) for r in rows]
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(y))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            r, v = rows[i], values[i]
            gradient = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # a row and the constant have length one each
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(ratios, weights, bias, a, b); without rows of both classes every score is the same."""
    fitted = part >= SCALED_ON
    if len(set(y[fitted].tolist())) < 2:
        return np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0, float(np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1)))
    inner = [r for r, f in zip(rows, fitted, strict=True) if f]
    ratio = log_ratio(Rows(inner), y[fitted])
    w, bias = descend(inner, y[fitted], ratio)
    rest = ~fitted if len(set(y[~fitted].tolist())) == 2 else fitted
    a, b = platt(margins([r for r, f in zip(rows, rest, strict=True) if f], ratio, w, bias), y[rest])
    return ratio, w, bias, a, b


def margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(rows), bias)
    for i, r in enumerate(rows):
        if len(r):
            v = ratio[r]
            out[i] += w[r] @ v / max(1e-12, np.sqrt(v @ v))
    return out


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """A function of (bytes, offsets) that scores texts: the estimated probability of label 1."""
    ratio, w, bias, a, b = fit_in_one_task(sample(docs, labels, label), features, fit)
    ratio, w = ratio.astype(np.float32), w.astype(np.float32)
    return lambda data, offsets: sigmoid(a * margins(features(data, offsets), ratio, w, bias) + b)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs(doc_id, text).

    A null text scores as an empty one; a null id is not held out. Without labels of both classes every score is the
    same. Rows of fold 0, ids without exactly one label and null labels are not learned from. An empty table gives no
    rows. Other columns are ignored.
    """
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
