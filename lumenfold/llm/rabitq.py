"""Near-duplicate vectors by randomised-rotation binary codes.

A vector, scaled to length one and rotated at random, keeps the signs of its components (one bit a dimension) and the
correction factor c = <signs / sqrt(D), rotated vector>. For another rotated vector q, <signs / sqrt(D), q> / c is an
unbiased estimate of the inner product, and its error exceeds EPS * sqrt((1 - c^2) / c^2 / (D - 1)) hardly ever; at a
cosine near the threshold the bound is over four standard errors. As the other side a vector is kept in 4 bits a
dimension; the bound grows by ROUNDING standard errors of these. Pairs whose upper
bound stays below the threshold are dropped; every other pair is recomputed in double precision, so no link is below the
threshold.

Which pairs are estimated: identical vectors are one class first. Classes meet in buckets of k bits of their codes
under several rotations; k grows with the logarithm of the number of classes, the number of tables is what a miss rate
of MISS at the threshold asks for (higher cosines are missed far more rarely). Buckets above BLOCK rows are dealt out
as pairs of blocks. Only codes go to all tables (about 70 bytes a row at 64 dimensions); vectors go to the cells in which
the bounds leave a pair of theirs open. A pair is counted only in the first table that both share, so tasks return sums of
links and spanning edges, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, spread, table
from .components import connected_components, roots
from .minhash import _groups

THRESHOLD = 0.9
EPS = 1.9
#: Standard errors of the 4-bit side's rounding that a bound allows for.
ROUNDING = 5.0
LEVELS = 4
MISS = 1e-6
BUCKET = 512
BLOCK = 4096
TILE = 512


def rotation(dim: int, number: int) -> np.ndarray:
    """Random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([dim, number, 9001])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors of a list column in double precision; None where null, empty, zero or not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    valid = np.asarray(column.is_valid())
    out: list[np.ndarray | None] = []
    for ok, lo, hi in zip(valid.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        v = values[lo:hi] if ok else values[:0]
        out.append(v if len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, the last one filled up with zeros."""
    raw = np.packbits(bits, axis=-1)
    out = np.zeros((*raw.shape[:-1], -(-raw.shape[-1] // 8) * 8), dtype=np.uint8)
    out[..., : raw.shape[-1]] = raw
    return out.view(np.uint64)


def bits(packed: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(packed).view(np.uint8), axis=1, count=dim).astype(np.float32)


def encode(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, factor, planes, scale) of unit vectors: sign bits, correction factors; 4 bits of each component by bit, with the lowest value and the step."""
    dim = u.shape[1]
    z = u @ rotation(dim, 0).T
    low = z.min(axis=1)
    step = np.maximum((z.max(axis=1) - low) / (2**LEVELS - 1), 1e-30)
    level = np.rint((z - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = words(np.stack([level >> b & 1 for b in range(LEVELS)], axis=1))
    return words(z >= 0), np.abs(z).sum(axis=1) / math.sqrt(dim), planes, np.stack([low, step], axis=1)


def upper_bounds(dim: int, code: np.ndarray, factor: np.ndarray, planes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(rows of code, rows of planes): what the inner product is hardly ever above."""
    if dim < 8:
        return np.full((len(code), len(planes)), np.inf)  # too few dimensions for the bound to mean anything
    # signs times levels: the four bit counts together, and ten times faster as one product of matrices
    sign = bits(code, dim) * np.float32(2) - np.float32(1)
    level = sum(bits(planes[:, b], dim) * np.float32(2**b) for b in range(LEVELS))
    low, step = scale[:, :1].astype(np.float32), scale[:, 1:2].astype(np.float32)
    hits = (sign / np.float32(math.sqrt(dim))) @ (low + step * level).T
    step = step[:, 0]
    error = EPS * np.sqrt(np.maximum(0, 1 - factor**2) / max(1, dim - 1))
    hits += error[:, None].astype(np.float32)
    hits += np.float32(ROUNDING / math.sqrt(12)) * step
    hits /= factor[:, None].astype(np.float32)
    return hits


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = vectors(batch.column("embedding"))
        vec = [None if v is None else (v + 0.0).tobytes() for v in found]
        cls = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vec]
        code: list[bytes | None] = [None] * len(vec)
        for dim in {len(v) for v in found if v is not None}:
            at = [i for i, v in enumerate(found) if v is not None and len(v) == dim]
            for i, row in zip(at, _packed(unit(np.array([found[i] for i in at]))), strict=True):
                code[i] = row
            for i in at:  # single precision where it holds the vector
                short = found[i].astype(np.float32)
                if (short.astype(np.float64) == found[i]).all():
                    vec[i] = (short + np.float32(0)).tobytes()
        dims = [None if v is None else len(v) for v in found]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(cls, pa.binary()), pa.array(vec, pa.binary()), pa.array(code, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "cls", "vec", "code", "dim"])


def _packed(u: np.ndarray) -> list[bytes]:
    """Code, planes, factor and scale of each unit vector as one string."""
    code, factor, planes, scale = encode(u)
    numbers = np.concatenate([factor[:, None], scale], axis=1).astype("<f4")
    return [c.tobytes() + p.tobytes() + x.tobytes() for c, p, x in zip(code, planes, numbers, strict=True)]


def _unpacked(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    width = -(-dim // 64)
    x = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
    code = np.ascontiguousarray(x[:, : 8 * width]).view(np.uint64)
    planes = np.ascontiguousarray(x[:, 8 * width : 8 * width * (1 + LEVELS)]).view(np.uint64).reshape(len(raw), LEVELS, width)
    numbers = np.ascontiguousarray(x[:, 8 * width * (1 + LEVELS) :]).view("<f4").astype(np.float64)
    return code, numbers[:, 0], planes, numbers[:, 1:]


def doubles(raw: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in raw], dtype=np.float64)


def plan(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a bucket, number of tables) for so many classes."""
    bits = max(4, round(math.log2(max(1, classes) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def table_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) bucket numbers of unit vectors; rotation 0 is left to the estimates."""
    n, dim = x.shape
    each = max(1, dim // bits)
    out = np.zeros((n, tables), dtype=np.int64)
    for t in range(0, tables, each):
        signs = (x @ rotation(dim, 1 + t // each).T >= 0).astype(np.int64)
        for k in range(t, min(t + each, tables)):
            part = signs[:, (k - t) * bits : (k - t + 1) * bits]
            out[:, k] = part @ (1 << np.arange(part.shape[1], dtype=np.int64))
    return out


def _bucketed(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, dims = batch.column("vec").to_pylist(), batch.column("dim").to_pylist()
        keys: list[list[int]] = [[]] * len(raw)
        for dim in set(dims):
            at = [i for i, v in enumerate(dims) if v == dim]
            found = table_keys(unit(doubles([raw[i] for i in at], dim)), bits, tables)
            # table, vector length and bucket make one number
            found = (found * tables + np.arange(tables)) * 65536 + dim % 65536
            for k, i in enumerate(at):
                keys[i] = found[k].tolist()
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(keys, pa.list_(pa.int64()))], ["cls", "keys"])


def _open(dim: int, codes: list[bytes], block: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j, of different blocks if there are several, whose upper bound reaches the threshold."""
    code, factor, planes, scale = _unpacked(codes, dim)
    cross = len(np.unique(block)) > 1
    for lo in range(0, len(codes), TILE):
        i, j = np.nonzero(upper_bounds(dim, code[lo : lo + TILE], factor[lo : lo + TILE], planes, scale) >= threshold - 1e-6)
        i += lo
        ok = i < j
        if cross:
            ok &= block[i] != block[j]
        yield i[ok], j[ok]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell and key: cells are named by a hash."""
    for t in _groups(batches, "cell"):
        keys = np.asarray(t["key"])
        for key in np.unique(keys).tolist():
            g = t.filter(pa.array(keys == key))
            dims = np.asarray(g["dim"])
            for dim in np.unique(dims).tolist():  # lengths that are the same modulo 65536
                if (dims == dim).sum() > 1:
                    yield g.filter(pa.array(dims == dim))


def _undecided(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that have a pair there which the bounds leave open."""
    for g in _buckets(batches):
        held = np.zeros(g.num_rows, dtype=bool)
        for i, j in _open(int(g["dim"][0].as_py()), g["code"].to_pylist(), np.asarray(g["block"]), threshold):
            held[i] = held[j] = True
        if held.any():
            yield from g.filter(pa.array(held)).select(["cell", "key", "block", "cls"]).combine_chunks().to_batches()


_OUT = "cls binary, links long, root binary"


def _pairs(batches: Iterator[pa.RecordBatch], bits: int, tables: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each cell, exactly: links of each class and a spanning forest of them, over the pairs that are open and share no earlier table."""
    for g in _buckets(batches):
        dim = int(g["dim"][0].as_py())
        u = unit(doubles(g["vec"].to_pylist(), dim))
        no = int(g["key"][0].as_py()) // 65536 % tables
        own = table_keys(u, bits, tables)[:, : no + 1]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _open(dim, g["code"].to_pylist(), np.asarray(g["block"]), threshold):
            for s in range(0, len(i), 100_000):
                p, q = i[s : s + 100_000], j[s : s + 100_000]
                near = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                p, q = p[near], q[near]
                first = (own[p] == own[q]).argmax(axis=1) == no
                a.append(p[first])
                b.append(q[first])
        a, b = np.concatenate(a), np.concatenate(b)
        if not len(a):
            continue
        size, cls = np.asarray(g["size"]), g["cls"].to_pylist()
        links = np.bincount(a, weights=size[b], minlength=len(cls)) + np.bincount(b, weights=size[a], minlength=len(cls))
        label = roots(a, b, len(cls))
        at = np.flatnonzero(links).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in at], pa.binary()), pa.array(links[at].astype(np.int64)), pa.array([cls[label[i]] for i in at], pa.binary())], ["cls", "links", "root"])


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of embeddings(vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and a component of their
    own; vectors of different lengths are never linked. Repeated rows are vectors that link with each other. A null
    vec_id links like any other, but names no component: component_id is the smallest known id (null if there is none)
    and kept is false. An empty table gives no rows. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = materialise(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_prepare, "vec_id long, cls binary, vec binary, code binary, dim int"))
    usable = rows.where("cls is not null")
    sizes = usable.groupBy("cls").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("low"))
    classes = materialise(usable.dropDuplicates(["cls"]).drop("vec_id").join(sizes, "cls"))
    bits, tables = plan(classes.count(), threshold)
    keyed = materialise(classes.select("cls", "vec", "dim").mapInArrow(lambda x: _bucketed(x, bits, tables), "cls binary, keys array<long>")).select("cls", F.explode("keys").alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = placed.select("cls", "key", "block", other).withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    cells = cells.select("cell", "key", "block", "cls").join(classes.select("cls", "code", "dim"), "cls")
    cells = cells.repartition(spread(spark), "cell").sortWithinPartitions("cell")
    undecided = materialise(cells.mapInArrow(lambda x: _undecided(x, threshold), "cell long, key long, block int, cls binary"))
    held = undecided.join(classes.drop("low"), "cls").repartition(spread(spark), "cell").sortWithinPartitions("cell")
    found = materialise(held.mapInArrow(lambda x: _pairs(x, bits, tables, threshold), _OUT))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    part = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = materialise(classes.select("cls", "size", "low").join(part.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "low", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    # stored before it is joined, so that the join can be split where a component is large
    smallest = materialise(named.groupBy("root").agg(F.min("low").alias("component")))
    named = named.join(smallest, "root").select("cls", "n", "component")
    # unusable rows, however many, don't meet in the join
    unusable = rows.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = usable.select("vec_id", "cls").join(named, "cls").select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return out.unionByName(unusable).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT n, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.n AS a, b.n AS b FROM u a JOIN u b ON a.n <> b.n
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END
), d AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT n AS a, n AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS n, min(v.vec_id) AS component_id FROM r JOIN v ON r.b = v.n GROUP BY r.a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN c USING (n) LEFT JOIN d USING (n)
"""
