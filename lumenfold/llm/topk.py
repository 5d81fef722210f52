"""Exact top-k inner products by norm buckets.

Candidates are range-partitioned by length, longest first, so each bucket holds vectors of similar length. A query
starts with the k-th best product among a bounded set of the longest vectors: a lower bound of its k-th best score. Of a
bucket whose longest vector has length l, only vectors with a cosine of at least bound / (|q| l) can matter:

* above 1, the bucket is skipped;
* high (COORDINATE and more), coordinate pruning: on the query's largest coordinates, a vector must lie in the interval
  that this cosine allows;
* else length pruning: the prefix of vectors with length >= bound / |q|.

What is left is verified with its full product; the bound rises as the bucket is worked through. Components are whole
numbers, so double-precision products are exact below 2**53; beyond it they only rule out what they can, with room for
their error, and what is left is multiplied in Python integers.

Queries lie in blocks of about as many buckets to look at, which the first bounds tell; a query goes to no further
bucket and a bucket to no further block. The driver holds a few numbers a bucket and one a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialise, spread, table
from .minhash import _groups

K = 5
SCALE = 256
EVERY = 50
#: Longest vectors that give the first bounds; candidates of a bucket; queries of a block; candidates of a step.
SEEDS, BUCKET, QUERIES, STEP = 1024, 16384, 512, 2048
#: Local cosine threshold from which coordinate pruning is used, and the coordinates it looks at.
COORDINATE, FOCUS = 0.6, 3
_EXACT = 2.0**52
#: Error of a double-precision product, as a share of the two lengths.
_ERROR = 1e-12
#: Scores are ranked as decimals of 38 digits, and given as longs.
_SCORE = pa.decimal128(38, 0)
_MOST, _LONG = 10**38 - 1, 2**63 - 1


def _length(v: np.ndarray) -> float:
    top = float(np.abs(v).max(initial=0.0))
    return top * math.sqrt(float(((v / top) ** 2).sum())) if top else 0.0


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        offsets, values = np.asarray(column.offsets).tolist(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        ids, vec, norm = [], [], []
        for vec_id, ok, lo, hi in zip(batch.column("vec_id").to_pylist(), np.asarray(column.is_valid()).tolist(), offsets[:-1], offsets[1:], strict=True):
            with np.errstate(over="ignore"):
                v = np.floor(scale * values[lo:hi])
            if ok and vec_id is not None and np.isfinite(v).all():
                ids.append(vec_id), vec.append(v.tobytes()), norm.append(_length(v))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vec, pa.binary()), pa.array(norm, pa.float64())], ["vec_id", "vec", "norm"])


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of whole numbers; a component that a shorter vector lacks is zero."""
    out = np.zeros((len(raw), dim))
    for i, x in enumerate(raw):
        out[i, : len(x) // 8] = np.frombuffer(x)
    return out


def approximate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Double-precision products; infinite where they can't be told."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ v.T
    s[np.isnan(s)] = np.inf
    return s


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers, pair by pair: whole doubles, or Python integers where doubles don't hold them."""
    lengths = np.array([_length(x) for x in q]).max(initial=0.0) * np.array([_length(x) for x in v]).max(initial=0.0)
    if lengths < _EXACT:
        return np.einsum("ij,ij->i", q, v)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True)] + [None], dtype=object)[:-1]


def _best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, ties to the smaller vec_id."""
    rank = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
    order = np.lexsort((vec_id, -rank, query))
    first = np.ones(len(order), dtype=bool)
    first[1:] = query[order][1:] != query[order][:-1]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


def search(ids: np.ndarray, q: np.ndarray, bound: np.ndarray, vec_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score): each query's k best of one bucket that reach its bound; v is sorted by length, longest first."""
    bound = bound.copy()
    qn, vn = np.array([_length(x) for x in q]), np.array([_length(x) for x in v])
    inexact = qn.max(initial=0.0) * vn.max(initial=0.0) >= _EXACT
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object if inexact else np.float64)
    slack = 1 + 1e-9
    for lo in range(0, len(v), STEP):
        part, length = v[lo : lo + STEP], vn[lo : lo + STEP]
        with np.errstate(all="ignore"):
            cosine = bound / qn / length[0]
            # a product in doubles may be so much below the true one
            error = qn * length[0] * _ERROR if inexact else np.zeros(len(q))
        cosine[~np.isfinite(cosine)] = np.where(bound[~np.isfinite(cosine)] > 0, np.inf, -np.inf)
        live = np.flatnonzero(cosine <= slack)
        if not len(live):
            break  # shorter vectors follow
        a, b, scores = [], [], []
        direction = None
        for i in live[cosine[live] >= COORDINATE].tolist():
            if direction is None:
                direction = part / np.maximum(length, 1e-300)[:, None]
            t, unit = min(1.0, cosine[i] / slack), q[i] / qn[i]
            keep = length * slack >= bound[i] / qn[i]
            for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
                reach = math.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-9
                keep &= (direction[:, f] >= unit[f] * t - reach) if unit[f] >= 0 else (direction[:, f] <= unit[f] * t + reach)
            at = np.flatnonzero(keep)
            a.append(np.full(len(at), i)), b.append(at + lo), scores.append(approximate(q[i : i + 1], part[at])[0])
        rest = live[cosine[live] < COORDINATE]
        if len(rest):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where(bound[rest] > 0, bound[rest] / qn[rest], 0).min()
            upto = int(np.searchsorted(-length, -shortest / slack, "right"))
            s = approximate(q[rest], part[:upto])
            s[vec_ids[lo : lo + upto] == ids[rest][:, None]] = -np.inf  # rows of the query itself, however many
            floor = bound[rest]
            if upto > k:
                floor = np.maximum(floor, np.partition(s, upto - k, axis=1)[:, upto - k])
            with np.errstate(invalid="ignore"):
                i, j = np.nonzero(~(s < (floor - 2 * error[rest])[:, None]))
            a.append(rest[i]), b.append(j + lo), scores.append(s[i, j])
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(scores)
        other = vec_ids[b] != ids[a]
        a, b, s = a[other], b[other], s[other]
        if inexact:
            s = np.concatenate([products(q[a[x : x + 1000]], v[b[x : x + 1000]]).astype(object) for x in range(0, len(a), 1000)] or [s])
        a, b, s = np.concatenate([found[0], a]), np.concatenate([found[1], b]), np.concatenate([found[2], s.astype(found[2].dtype)])
        ok = np.array([x >= y for x, y in zip(s.tolist(), bound[a].tolist(), strict=True)], dtype=bool) if inexact else s >= bound[a]
        a, b, s = a[ok], b[ok], s[ok]
        at = _best(a, vec_ids[b], s, k)
        found = a[at], b[at], s[at]
        full, count = np.unique(found[0], return_counts=True)
        for i in full[count >= k].tolist():
            least = min(found[2][found[0] == i].tolist())
            try:
                near = float(least)
            except OverflowError:
                near = math.copysign(math.inf, least)
            if near > least:  # the next double is above the score
                near = math.nextafter(near, -math.inf)
            bound[i] = max(bound[i], near)
    return found


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, "cell"):
        raw, is_query = t["vec"].to_pylist(), np.asarray(t["bound"].is_valid())
        norm, ids = np.asarray(t["norm"]), np.asarray(t["vec_id"])
        dim = max(len(x) for x in raw) // 8
        of_q = np.flatnonzero(is_query)
        of_v = np.flatnonzero(~is_query)
        of_v = of_v[np.argsort(-norm[of_v], kind="stable")]
        if not len(of_q) or not len(of_v):
            continue
        bound = t["bound"].to_numpy()[of_q].astype(np.float64)
        a, b, s = search(ids[of_q], _matrix([raw[i] for i in of_q], dim), bound, ids[of_v], _matrix([raw[i] for i in of_v], dim), k)
        score = pa.array([Decimal(max(-_MOST, min(_MOST, int(x)))) for x in s.tolist()], _SCORE)
        yield pa.RecordBatch.from_arrays([pa.array(ids[of_q][a]), pa.array(ids[of_v][b]), score], ["query_id", "vec_id", "score"])


def _first_bounds(batches: Iterator[pa.RecordBatch], seeds: list[tuple[int, bytes]], longest: list[float], k: int) -> Iterator[pa.RecordBatch]:
    seed_ids = np.array([i for i, _ in seeds], dtype=np.int64)
    falling = -np.array(longest)
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        if not raw:
            continue
        dim = max([len(x) for x in raw] + [len(x) for _, x in seeds]) // 8
        s = approximate(_matrix(raw, dim), _matrix([x for _, x in seeds], dim))
        s[np.asarray(batch.column("vec_id"))[:, None] == seed_ids] = -np.inf
        bound = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(raw), -np.inf)
        norm = np.asarray(batch.column("norm"))
        with np.errstate(all="ignore"):
            if norm.max() * longest[0] >= _EXACT:
                bound = bound - norm * longest[0] * _ERROR
            bound = np.where(np.isfinite(bound), bound, -np.inf)
            # buckets whose longest vector may reach the bound
            upto = np.where(bound > 0, np.searchsorted(falling, -bound / norm / (1 + 1e-9), "right"), len(longest))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), batch.column("norm"), pa.array(bound), pa.array(upto.astype(np.int32))], ["vec_id", "vec", "norm", "bound", "upto"])


def blocks(queries: dict[int, int], buckets: int, size: int = QUERIES) -> tuple[list[int], list[int], list[int]]:
    """For each number of buckets to look at (0 to buckets): the first block of its queries and how many these are dealt over; of each block, the most buckets, falling.

    queries: how many there are of each number. Numbers that follow each other share a block until it has size queries.
    """
    first, many, most = [0] * (buckets + 1), [1] * (buckets + 1), []
    held: list[int] = []
    for upto in [*range(buckets, -1, -1), -1]:
        n = sum(queries.get(u, 0) for u in held)
        if held and (n >= size or upto < 0):
            k = max(1, math.ceil(n / size))
            for u in held:
                first[u], many[u] = len(most), k
            most += [held[0]] * k
            held = []
        held.append(upto)
    return first, many, most


def top_products(embeddings: DataFrame, every: int = EVERY, scale: int = SCALE, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with vec_id divisible by every, its k highest inner products of floor(scale * x).

    A query's candidates are all rows with another vec_id; ties go to the smaller vec_id; fewer candidates give fewer
    rows. Rows that are null, hold null or non-finite components (a component that is too large to be scaled is one) or
    have no vec_id take no part; zero and empty vectors do, with products of 0; a component that a shorter vector lacks
    counts as 0. A vec_id that repeats is one query, and each of its rows a candidate of others. Products are exact and
    ranked as such up to 38 digits; a score beyond a long is given as the nearest long. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = materialise(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(lambda x: _whole(x, scale), "vec_id long, vec binary, norm double"))
    buckets = max(1, math.ceil(rows.count() / BUCKET))
    ranged = materialise(rows.repartitionByRange(buckets, F.desc("norm"), F.col("vec_id")).withColumn("bucket", F.spark_partition_id()))
    longest = {r["bucket"]: r["longest"] for r in ranged.groupBy("bucket").agg(F.max("norm").alias("longest")).collect()}
    buckets = max(longest, default=-1) + 1
    # an empty bucket is as long as the one after it
    falling = [0.0] * buckets
    for b in range(buckets - 1, -1, -1):
        falling[b] = longest.get(b, falling[b + 1] if b + 1 < buckets else 0.0)
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    seeds = [(r["vec_id"], bytes(r["vec"])) for r in rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()]
    queries = materialise(queries.mapInArrow(lambda x: _first_bounds(x, seeds, falling, k), "vec_id long, vec binary, norm double, bound double, upto int"))
    first, many, most = blocks({r["upto"]: r["count"] for r in queries.groupBy("upto").count().collect()}, buckets, QUERIES)
    of = lambda values: F.element_at(F.lit(values).cast("array<int>"), F.col("upto") + 1)
    queries = queries.withColumn("block", of(first) + F.pmod(F.xxhash64("vec_id"), of(many)).cast("int"))
    # of each bucket, the blocks up to the last one that looks at it
    wanted = [sum(m > bucket for m in most) for bucket in range(buckets)]
    left = queries.where("upto > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)))
    reach = F.element_at(F.lit(wanted or [0]).cast("array<int>"), F.col("bucket") + 1)
    right = ranged.withColumn("reach", reach).where("reach > 0").withColumn("bound", F.lit(None).cast("double")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)))
    cell = (F.col("block").cast("long") * buckets + F.col("bucket")).alias("cell")
    cells = left.select(cell, "vec_id", "vec", "norm", "bound").unionByName(right.select(cell, "vec_id", "vec", "norm", "bound"))
    found = cells.repartition(spread(spark), "cell").sortWithinPartitions("cell").mapInArrow(lambda x: _cells(x, k), "query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = F.greatest(F.least(F.col("score"), F.lit(_LONG).cast("decimal(38,0)")), F.lit(-_LONG - 1).cast("decimal(38,0)")).cast("long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
