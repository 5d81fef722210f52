"""Near-duplicate documents by b-bit MinHash.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct 5-word shingles (with fewer
words the whole sequence is the one shingle; without words the set is empty and links with nothing).

1. One pass over the texts: class key (digest of the word sequence), set size, band keys (25 of 5 minima each at 0.85,
   32 of 4 at 0.8), and 128 minima cut to 2 bits (32 bytes).
2. Equal word sequences are one class; from here on classes are compared, so exact copies cost nothing.
3. Classes that share a band key meet in a task. Bit counts of the packed signatures give the collision-corrected
   similarity (match - 1/4) / (3/4); where it is at least the threshold less six standard errors, the pair is a
   candidate. A task emits a spanning forest of its candidates, not all pairs.
4. Each candidate is confirmed on the full shingle sets. Trees of a forest with an edge that isn't confirmed are joined to
   groups; in a group, rows of different parts are all compared on full sets, as bit rows over the shingles that
   several of them hold. Groups above GROUP_BLOCK rows or GROUP_SHINGLES shingles are dealt out as pairs of blocks. Only links that join parts are
   returned, so rows stay in proportion to the input.
5. Components over the confirmed links.

At the threshold a pair shares no band with probability (1 - threshold**rows)**bands < MISS. The threshold is 0.85, by
op10's contract, unless a caller names another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, mix, spread, table, text_chunks, text_column, words
from .components import connected_components, roots

SHINGLE = 5
#: Of op10's contract, in whole numbers.
THRESHOLD = (85, 100)
PERMS, BITS, MISS = 128, 2, 1e-6
#: Rows of a band that are compared in one task; beyond it, pairs of blocks are.
BAND_BLOCK = 1 << 15
#: Rows of an open group, and shingles of them together, that make a block; a task takes a pair of blocks.
GROUP_BLOCK, GROUP_SHINGLES = 4096, 1 << 21
#: Bytes of the bit rows of a cell; where they would take more, intersections are counted from lists of rows.
BIT_ROWS = 1 << 28
#: Standard errors of the estimate between the threshold and the floor of candidates.
ERRORS = 6

_rng = np.random.Generator(np.random.PCG64(71))
_FLIP = _rng.integers(0, 2**32, PERMS, dtype=np.uint32)
_ODD = _rng.integers(0, 2**31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = mix(np.arange(100, 100 + PERMS, dtype=np.uint64)) | np.uint64(1)
_NUMBER = np.arange(1, PERMS + 1, dtype=np.uint64) << np.uint64(32)
_SEED = mix(np.arange(1000, 1000 + PERMS, dtype=np.uint64))


def layout(threshold: tuple[int, int]) -> tuple[int, int]:
    """(bands, rows of a band): the longest bands of which a pair at the threshold misses all with a probability below MISS."""
    at = threshold[0] / threshold[1]
    fit = [(PERMS // rows, rows) for rows in range(1, PERMS + 1) if (1 - at**rows) ** (PERMS // rows) < MISS]
    if not fit:
        raise ValueError(f"{PERMS} minima are too few for a threshold of {at}")
    return fit[-1]


def floor_of(threshold: tuple[int, int]) -> float:
    """The least estimate of a candidate: the threshold less ERRORS standard errors."""
    at, chance = threshold[0] / threshold[1], 1 / 2**BITS
    match = at + (1 - at) * chance
    return at - ERRORS * float(np.sqrt(match * (1 - match) / PERMS)) / (1 - chance)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles (64-bit) of each text."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        rolled += hashes[k : k + len(rolled)] * _PLACE[k]
    rolled = mix(rolled)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(rolled[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield mix((hashes[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, 2**32 - 1, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        x = short[i : i + 1024, None] ^ _FLIP
        x *= _ODD
        np.minimum(low, x.min(axis=0), out=low)
    return low


def pack(low: np.ndarray) -> bytes:
    """Two bits of a hash of each minimum and its number: all first bits, then all second bits.

    The lowest bits of the minimum itself come from the same two bits of its shingle in every permutation.
    """
    low = mix(low + _NUMBER)
    return np.packbits(np.concatenate([low & 1, low >> 1 & 1]).astype(np.uint8)).tobytes()


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures: (4,) against (n, 4) uint64."""
    x = one ^ many
    half = x.shape[-1] // 2
    differ = np.bitwise_count(x[..., :half] | x[..., half:]).sum(axis=-1, dtype=np.int64)
    chance = 1 / 2**BITS
    return ((PERMS - differ) / PERMS - chance) / (1 - chance)


def class_key(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    bands, long = layout(threshold)
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            _, _, hashes, bounds = words(data, offsets)
            cls, size, keys, sig, raw = [], [], [], [], data.tobytes()
            for i, s in enumerate(shingle_sets(hashes, bounds)):
                size.append(len(s))
                if not len(s):
                    cls.append(None), keys.append(None), sig.append(None)
                    continue
                low = minima(s)
                cls.append(class_key(raw[offsets[i] : offsets[i + 1]]))
                rows = low[: bands * long].reshape(bands, long).astype(np.uint64)
                keys.append(mix((rows * _BAND[:long]).sum(axis=1) ^ _SEED[:bands]).view(np.int64))
                sig.append(pack(low))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi].cast(pa.int64()), pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "cls", "n_shingles", "keys", "sig"])


def forest(sig: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over all pairs of rows with an estimate of at least floor.

    Pivots gather what is close to them; then only rows of different trees are compared. One large group of near
    copies costs rows times pivots, not the square.
    """
    m = len(sig)
    tree = np.full(m, -1, dtype=np.int64)
    a, b = [], []
    rest = np.arange(m)
    while len(rest):
        pivot, rest = rest[0], rest[1:]
        tree[pivot] = pivot
        near = estimate(sig[pivot], sig[rest]) >= floor
        tree[rest[near]] = pivot
        a += [np.full(near.sum(), pivot)]
        b += [rest[near]]
        rest = rest[~near]
    names, counts = np.unique(tree, return_counts=True)
    if len(names) > 1:
        largest = names[counts.argmax()]
        for x in np.flatnonzero(tree != largest).tolist():
            other = np.flatnonzero(tree != tree[x])
            near = other[estimate(sig[x], sig[other]) >= floor]
            if len(near):
                _, first = np.unique(tree[near], return_index=True)
                a += [np.full(len(first), x)]
                b += [near[first]]
                tree[np.isin(tree, tree[near[first]])] = tree[x]
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
    return a, b


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal key in a sorted partition; only one run is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != int(k[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _as_words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _forests(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    floor = floor_of(threshold)
    out: list[tuple] = []
    for t in _groups(batches, "key"):
        if t.num_rows < 2:
            continue
        cls = t["cls"].to_pylist()
        a, b = forest(_as_words(t["sig"]), floor)
        label = roots(a, b, len(cls))
        key = t["key"][0].as_py()
        out += [(key, int(label[i]), *sorted((cls[i], cls[j]))) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _EDGE, strict=True)], ["key", "tree", "a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _EDGE, strict=True)], ["key", "tree", "a", "b"])


_EDGE = (pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column("text")):
            _, _, hashes, bounds = words(data, offsets)
            raw = data.tobytes()
            rows = [(class_key(raw[offsets[i] : offsets[i + 1]]), s.tobytes(), len(s)) for i, s in enumerate(shingle_sets(hashes, bounds)) if len(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["cls", "shingles", "held"])


def similar(x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Jaccard similarity of two sets of distinct shingles, in whole numbers."""
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return threshold[1] * both >= threshold[0] * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, i), (y, j) = text_column(batch.column("one")), text_column(batch.column("other"))
        ok = [similar(x[i[k] : i[k + 1]].view(np.uint64), y[j[k] : j[k + 1]].view(np.uint64), threshold) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("other"))
    return materialise(pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(lambda x: _confirm(x, threshold), "a binary, b binary, linked boolean"))


def intersections(row: np.ndarray, column: np.ndarray, rows: int, limit: int):
    """A function (i, others) -> how many columns row i shares with each other row, of a table of (row, column) pairs sorted by row.

    Bit rows where they take no more than limit bytes; else the lists of the rows that hold a column, whose size is that
    of the pairs.
    """
    width = (int(column.max()) // 64 + 1) if len(column) else 1
    if rows * width * 8 <= limit:
        bits = np.zeros((rows, width), dtype=np.uint64)
        np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
        step = max(1, (1 << 24) // (8 * width))

        def count(i: int, others: np.ndarray) -> np.ndarray:
            both = np.zeros(len(others), dtype=np.int64)
            for k in range(0, len(others), step):
                both[k : k + step] = np.bitwise_count(bits[i] & bits[others[k : k + step]]).sum(axis=1, dtype=np.int64)
            return both

        return count
    order = np.argsort(column, kind="stable")
    holders = row[order].astype(np.int32)
    first = np.searchsorted(column[order], np.arange(int(column.max()) + 2))
    begin = np.searchsorted(row, np.arange(rows + 1))

    def listed(i: int, others: np.ndarray) -> np.ndarray:
        both = np.zeros(rows, dtype=np.int64)
        mine = column[begin[i] : begin[i + 1]]
        for k in range(0, len(mine), 4096):
            c = mine[k : k + 4096]
            n = first[c + 1] - first[c]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[c], n)
            both += np.bincount(holders[at], minlength=rows)
        return both[others]

    return listed


def _exact_links(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Of each cell: links that join its parts, found by comparing every row outside the largest part with all rows of other parts, on full sets."""
    for t in _groups(batches, "cell"):
        cls = t["cls"].to_pylist()
        part = np.unique(np.array([x.hex() for x in t["part"].to_pylist()]), return_inverse=True)[1]
        block = np.asarray(t["block"])
        cross = len(np.unique(block)) > 1
        data, offsets = text_column(t["shingles"])
        size = np.diff(offsets) // 8
        _, name, count = np.unique(data[offsets[0] : offsets[-1]].view(np.uint64), return_inverse=True, return_counts=True)
        # what only one row holds is in no intersection
        column = np.cumsum(count > 1) - 1
        row = np.repeat(np.arange(len(cls)), size)
        common = count[name] > 1
        row, column = row[common], column[name[common]]
        shared = intersections(row, column, len(cls), BIT_ROWS)
        names, counts = np.unique(part, return_counts=True)
        out = []
        for i in np.flatnonzero(part != names[counts.argmax()]).tolist():
            other = np.flatnonzero((part != part[i]) & (block != block[i]) if cross else part != part[i])
            both = shared(i, other)
            near = other[threshold[1] * both >= threshold[0] * (size[i] + size[other] - both)]
            if len(near):
                _, first = np.unique(part[near], return_index=True)
                out += [tuple(sorted((cls[i], cls[j]))) for j in near[first].tolist()]
                part[np.isin(part, part[near[first]])] = part[i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])


def _links_of_open_groups(edges: DataFrame, checked: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame | None:
    """Links inside trees with an edge that wasn't confirmed; None where there is no such tree."""
    bad = edges.join(checked.where("not linked"), ["a", "b"]).select("key", "tree").distinct()
    bad = materialise(edges.join(bad, ["key", "tree"]).select("a", "b").distinct())
    if bad.isEmpty():
        return None
    group = connected_components(bad).select(F.col("node").alias("cls"), F.col("root").alias("group"))
    part = connected_components(checked.where("linked").select("a", "b")).select(F.col("node").alias("cls"), F.col("root").alias("part"))
    member = materialise(group.join(part, "cls", "left").select("cls", "group", F.coalesce("part", "cls").alias("part")))
    # a group that is one part has nothing left to find
    sized = member.join(sets.select("cls", "held"), "cls")
    open_ = sized.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"), F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y")
    open_ = open_.select("group", F.ceil(F.greatest(F.col("n") / GROUP_BLOCK, F.col("held") / GROUP_SHINGLES)).cast("int").alias("blocks"))
    placed = member.join(open_, "group").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    cells = placed.select(cell, "cls", "part", "block").join(sets.drop("held"), "cls")
    return materialise(cells.repartition(spread(edges.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(lambda x: _exact_links(x, threshold), "a binary, b binary"))


def _celled(banded: DataFrame) -> DataFrame:
    """Rows of bands with more than BAND_BLOCK rows are dealt out: every pair of blocks is a cell, which takes the band's place as key."""
    large = materialise(banded.groupBy("key").count().where(F.col("count") > BAND_BLOCK).select("key", F.ceil(F.col("count") / BAND_BLOCK).cast("int").alias("blocks")))
    if large.isEmpty():
        return banded
    placed = banded.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or block <> other")
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return placed.select(cell.alias("key"), "cls", "sig")


def link_classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows(doc_id, cls, n_shingles, keys, sig) of docs(doc_id, text); links(a, b): confirmed pairs of classes (similarity of at least threshold, a fraction), enough of them to connect every component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(docs.mapInArrow(lambda x: _signatures(x, threshold), "doc_id long, cls binary, n_shingles long, keys array<long>, sig binary"))
    # which of a class's copies stands for it does not matter: they have one signature
    reps = materialise(rows.where("cls is not null").dropDuplicates(["cls"]).select("cls", "keys", "sig"))
    banded = _celled(reps.select(F.explode("keys").alias("key"), "cls", "sig"))
    edges = materialise(banded.repartition(spread(spark), "key").sortWithinPartitions("key").mapInArrow(lambda x: _forests(x, threshold), "key long, tree long, a binary, b binary"))
    pairs = materialise(edges.select("a", "b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    # a class is one row before it meets anything: copies are summed up where they lie
    lowest = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("id"))
    ids = lowest.join(wanted, "cls", "left_semi").select("id").distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    sets = materialise(texts.mapInArrow(_sets, "cls binary, shingles binary, held long").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))
    checked = _verified(pairs, sets, threshold)
    links = checked.where("linked").select("a", "b")
    more = _links_of_open_groups(edges, checked, sets, threshold)
    return rows, links if more is None else links.unionByName(more)


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Null or blank texts: no shingles, a component of their own. Null doc_id: the row still links; its component_id is
    the smallest known id of its component (null if there is none), kept is false unless the id is known. Repeated rows
    are copies of one another. An empty table gives no rows. Other columns are ignored.
    """
    rows, links = link_classes(docs, threshold)
    part = connected_components(links)
    smallest = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    smallest = materialise(smallest.join(part.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "low"))
    # stored before it is joined, so that the join can be split where a component is large
    linked = materialise(smallest.groupBy("root").agg(F.min("low").alias("component_id")))
    named = smallest.join(linked, "root").select("cls", "component_id")
    # rows without words, however many, don't meet in the join
    blank = rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("cls is not null").select("doc_id", "cls", "n_shingles").join(named, "cls").select("doc_id", "n_shingles", "component_id").unionByName(blank)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id; a row without id counts as after all others.

    Of repeated rows (same id and text) one stays.
    """
    nameless = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    docs = docs.withColumn("keep_one_id", F.coalesce(F.col("doc_id").cast("long"), nameless))
    found = near_duplicates(docs.select(F.col("keep_one_id").alias("doc_id"), "text"), threshold)
    count = found.where("kept").groupBy(F.col("doc_id").alias("keep_one_id")).count()
    once = docs.join(count.where("count = 1").select("keep_one_id"), "keep_one_id", "left_semi")
    again = docs.join(count.where("count > 1").select("keep_one_id"), "keep_one_id", "left_semi").dropDuplicates(["keep_one_id", "text"])
    return once.unionByName(again).drop("keep_one_id")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), THRESHOLD)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT n, doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams, len(w) AS words
  FROM d
), k AS (SELECT n, doc_id, CASE WHEN words = 0 THEN 0 ELSE len(grams) END AS size, CASE WHEN words = 0 THEN [] ELSE grams END AS grams FROM s),
e AS (SELECT n, size, unnest(grams) AS gram FROM k),
l AS (
  SELECT a.n AS a, b.n AS b FROM e a JOIN e b ON a.gram = b.gram AND a.n <> b.n
  GROUP BY a.n, b.n, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
), r AS (SELECT n AS a, n AS b FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS n, min(k.doc_id) AS component_id FROM r JOIN k ON r.b = k.n GROUP BY r.a)
SELECT doc_id, CAST(size AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM k JOIN c USING (n)
"""
