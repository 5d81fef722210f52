"""What the text classifiers share: labelled samples, hashed features, scoring."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_chunks

#: Labelled documents of each class that a model is fitted on, the first by a hash of their id, and bytes of their texts
#: together. The only bounded sample.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
FOLDS = 5
DIMENSIONS = 1 << 18

Features = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(id, y) of all labels that may be learned from: none of fold 0, none of ids with two labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0))
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").drop("z")


def prior_shift(labels: DataFrame, label: str, per_class: int = SAMPLE) -> float:
    """What the logarithm of the odds of label 1 among all labels differs by from that of the sample."""
    n = {r["y"]: r["n"] for r in known_labels(labels, label).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return 0.0
    return float(np.log(n[1] / n[0]) - np.log(min(n[1], per_class) / min(n[0], per_class)))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE, per_class_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, text, y, part): up to per_class labelled documents of each class, whole texts of at most per_class_bytes together.

    An id whose rows have several texts is learned from by the shortest (of equals, the first by a hash); rows with that
    text are all there, and fit_in_one_task takes one of them. A null text is empty.
    """
    known = known_labels(labels, label)
    each = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids
    chosen = F.broadcast(each[0].unionByName(each[1]))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # one text an id, told by its length and digest: no text is shuffled to choose
    named = texts.join(chosen, texts["doc_id"] == chosen["id"]).select("id", "y", F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).alias("one"))
    named = named.groupBy("id", "y").agg(F.min("one").alias("one"))
    upto = F.sum("one.n").over(Window.partitionBy("y").orderBy(F.xxhash64(F.lit(5), "id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    named = F.broadcast(named.withColumn("upto", upto).where(F.col("upto") <= per_class_bytes))
    same = (texts["doc_id"] == named["id"]) & (F.octet_length(texts["text"]) == named["one.n"]) & (F.xxhash64(texts["text"]) == named["one.h"])
    return texts.join(named, same).select("id", "text", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(100)).cast("int").alias("part"))


def _featured(batches: Iterator[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    """Features of each id's text, once a partition."""
    seen: set = set()
    for batch in batches:
        new = [x not in seen and not seen.add(x) for x in batch.column("id").to_pylist()]
        batch = batch.filter(pa.array(new, pa.bool_()))
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            x = [f.astype(np.int32).tobytes() for f in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], batch.column("y")[lo:hi], batch.column("part")[lo:hi], pa.array(x, pa.binary())], ["id", "y", "part", "x"])


class Rows:
    """Sparse indicator rows; products go through blocks of them, so temporaries stay small."""

    BLOCK = 1 << 20

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows
        ends = np.cumsum([len(r) for r in rows])
        cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + self.BLOCK, self.BLOCK), "right")
        self.blocks = [(lo, hi) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if hi > lo]
        if rows and (not self.blocks or self.blocks[-1][1] < len(rows)):
            self.blocks.append((self.blocks[-1][1] if self.blocks else 0, len(rows)))
        #: Small tables are taken apart once.
        self.held = list(self._made()) if len(self.blocks) <= 2 else None

    def _parts(self):
        return self._made() if self.held is None else self.held

    def _made(self):
        for lo, hi in self.blocks:
            yield lo, hi, np.concatenate(self.rows[lo:hi]).astype(np.int64), np.repeat(np.arange(hi - lo), [len(r) for r in self.rows[lo:hi]])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.rows))
        for lo, hi, index, row in self._parts():
            out[lo:hi] = np.bincount(row, weights=w[index], minlength=hi - lo)
        return out

    def back(self, g: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
        out = np.zeros(dimensions)
        for lo, hi, index, row in self._parts():
            out += np.bincount(index, weights=g[lo:hi][row], minlength=dimensions)
        return out


def fit_in_one_task(examples: DataFrame, features: Features, fit: Callable[[list, np.ndarray, np.ndarray], object]) -> object:
    """The model that fit(rows, y, part) makes of the bounded sample; rows come in an order that doesn't depend on tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = {}
        for b in batches:
            one.update((i, (x, y, p)) for i, x, y, p in zip(*(b.column(c).to_pylist() for c in ("id", "x", "y", "part")), strict=True))
        held = sorted(one.values())
        rows = [np.frombuffer(x, np.int32) for x, _, _ in held]
        model = fit(rows, np.array([y for _, y, _ in held]), np.array([p for _, _, p in held]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    kind = examples.schema["id"].dataType.simpleString()
    made = examples.mapInArrow(lambda b: _featured(b, features), f"id {kind}, y int, part int, x binary").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else fit([], np.zeros(0, int), np.zeros(0, int))


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score(data, offsets) for _, _, data, offsets in text_chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs whose score is to be kept, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [keep(score(data, offsets)) for _, _, data, offsets in text_chunks(batch.column("text"))]
            if out:
                yield batch.filter(pa.array(np.concatenate(out)))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), with Platt's smoothed targets and a >= 0."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - target)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(0.0, w[0])), float(w[1])
