"""Removal of repeated passages: every byte covered by a 200-byte string that also starts anywhere else.

Texts are UTF-8 bytes. Two equal strings must meet in one task, wherever their documents lie:

1. Anchors. Of the hashes of all KMER-byte strings inside a window of LENGTH bytes, the smallest (the leftmost of equals)
   is the window's anchor. Equal windows have equal anchors at equal places. Windows that follow each other share an anchor
   over about (LENGTH - KMER) / 2 bytes, so anchors are few; their counts over the corpus leave those that occur twice.
2. Pieces. The windows of an occurrence of a repeated anchor make a piece of text, with the bytes that its last window
   needs. Each window of the corpus lies in one piece at most, and equal windows lie in pieces of one anchor. Equal pieces
   of an anchor are folded into one with a count, first where they are cut; a count above one makes all its windows
   repeats. An anchor without a second piece that differs needs nothing more.
3. An anchor with more than HOT different pieces is too much for a shard: those pieces are split by the place of the anchor
   in the window and the bytes that all windows of that place share, and folded again. Where even then more than HOT
   different parts share a key, single windows are counted by digest. What is split are different pieces, never their
   occurrences, so copies, however many, cost a row each.
4. Shards. The pieces of whole anchors fill shards of about SHARD bytes. A shard's suffix array is induced, the
   permuted common prefixes computed, and a window is a repeat where it shares LENGTH bytes with a neighbour in the order.
5. Runs of repeated windows go back to the documents by class (digest of the text); texts that occur twice as a whole are
   one class, counted once, and lose all their bytes if they have LENGTH.

Pieces and texts are told apart by digests (128 and 256 bits); two anchors of one 64-bit hash would only share a shard.
Matches are judged on the input and never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, materialise, mix, powers, prefix_hash, spread, table, text_chunks, text_column, tidy
from .suffixes import common_prefixes, suffix_array

LENGTH = 200
KMER = 32
SHARD = 1 << 20
#: Different pieces (of 367 bytes at most) that one key may bring into a shard.
HOT = 4096
#: Places of a hot anchor in a window that are kept together.
PLACES = 16
#: Keys that are sent to all executors; more of them are joined by a shuffle.
FEW = 100_000
#: Windows that one vectorised step looks at.
STEP = 1 << 22
_LOW = np.uint64((1 << 24) - 1)


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    h = prefix_hash(data)
    return mix((h[KMER:] - h[:-KMER]) * powers(len(data) + 1)[1][: len(data) - KMER + 1])


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by running minima of blocks from both sides."""
    n = len(v) - width + 1
    size = -(-len(v) // width) * width
    block = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    block[: len(v)] = v
    block = block.reshape(-1, width)
    right = np.minimum.accumulate(block, axis=1).ravel()
    left = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window from its text's start, bounds of each text) of all texts; an anchor's windows end where the next one's begin."""
    width = LENGTH - KMER + 1
    found, first = [], []
    n = len(data) - LENGTH + 1
    last = offsets[1:] - LENGTH + 1  # of each text: its windows end here
    for lo in range(0, max(0, n), STEP):
        part = data[lo : lo + STEP + LENGTH - 1]
        k = kmer_hashes(part)
        at = (window_minima((k & ~_LOW) | np.arange(len(k), dtype=np.uint64), width) & _LOW).astype(np.int64)
        change = np.ones(len(at), dtype=bool)
        change[1:] = at[1:] != at[:-1]
        inside = np.zeros(len(at) + 1, dtype=np.int64)
        some = offsets[:-1] < last
        np.add.at(inside, np.clip(offsets[:-1][some] - lo, 0, len(at)), 1)
        np.add.at(inside, np.clip(last[some] - lo, 0, len(at)), -1)
        begins = offsets[:-1] - lo
        change[begins[(begins >= 0) & (begins < len(at))]] = True
        i = np.flatnonzero(change & (np.cumsum(inside[:-1]) > 0))
        found.append(k[at[i]].view(np.int64))
        first.append(i + lo)
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    first = np.concatenate(first).astype(np.int64) if first else np.zeros(0, np.int64)
    bounds = np.searchsorted(first, offsets)
    return found, first - np.repeat(offsets[:-1], np.diff(bounds)), bounds


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column("text")):
            found, first, bounds = anchors(data, offsets)
            raw = data.tobytes()
            cls = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cls, pa.binary()),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(first, pa.int32())),
                ],
                ["cls", "n_bytes", "anchors", "firsts"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, half, text) of texts with a window, each once a batch; texts are packed, as all of them are shuffled once."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        seen: dict[bytes, bytes] = {}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= LENGTH:
                text = data[a:b].tobytes()
                cls = hashlib.sha256(text).digest()
                if cls not in seen:
                    seen[cls] = pack(text)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c[:16] for c in seen], pa.binary()), pa.array(list(seen.values()), pa.binary())], ["cls", "half", "text"])


def split_hot(text: np.ndarray, anchor: int, first: int, last: int, places: int = PLACES) -> Iterator[tuple[int, int, int]]:
    """(key, first, last) of the parts of a hot anchor's windows first <= s < last: by the anchor's place in the window and the bytes that windows of that place share."""
    k = kmer_hashes(text[first : first + LENGTH]).view(np.int64)
    p = first + int(np.flatnonzero(k == anchor)[0])
    s = first
    while s < last:
        place = (p - s) // places
        upto = min(last, p - place * places + 1)  # windows s with (p - s) // places == place
        core = text[p - place * places : p - place * places + LENGTH - places + 1]
        digest = hashlib.blake2b(core.tobytes() + f"{anchor} {place}".encode(), digest_size=8).digest()
        yield int.from_bytes(digest, "little", signed=True), s, upto
        s = upto


_PIECE = "cls binary, anchor long, first long, name binary, n long, piece binary, many boolean, text binary"


def digest(piece: bytes) -> bytes:
    return hashlib.md5(piece, usedforsecurity=False).digest()


def _pieces(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Three kinds of rows: the text of each class; where a piece occurs (cls, anchor, first, name); a piece's bytes, how often the batch has it, and whether its anchor has more than hot occurrences."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        packed = batch.column("text").to_pylist()
        spots = batch.column("spots").to_pylist()
        out: list[tuple] = []
        folded: dict[tuple[int, bytes], list] = {}
        size = 0
        for i, cls in enumerate(batch.column("cls").to_pylist()):
            text = unpack(packed[i])
            out.append((cls, None, None, None, None, None, None, packed[i]))
            size += len(packed[i])
            for x in spots[i]:
                first, last = x["ends"] >> 32, x["ends"] & 0xFFFFFFFF
                piece, anchor = text[first : last + LENGTH - 1], x["anchor"]
                name = digest(piece)
                out.append((cls, anchor, first, name, None, None, None, None))
                if (anchor, name) in folded:
                    folded[anchor, name][1] += 1
                else:
                    folded[anchor, name] = [piece, 1, x["n"] > hot]
                    size += len(piece)
            if size > 2 << 20:
                yield _rows(out, folded)
                out, folded, size = [], {}, 0
        if out:
            yield _rows(out, folded)


def _rows(out: list[tuple], folded: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
    out += [(None, anchor, None, name, n, piece, many, None) for (anchor, name), (piece, n, many) in folded.items()]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["cls", "anchor", "first", "name", "n", "piece", "many", "text"])


_PART = "anchor long, name binary, at long, key long, part binary, n long, piece binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the pieces of hot anchors: where in its piece a part begins, the key under which equal windows meet, its digest and bytes."""
    for batch in batches:
        rows = []
        for anchor, name, n, piece in zip(batch.column("anchor").to_pylist(), batch.column("name").to_pylist(), batch.column("n").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            text = np.frombuffer(piece, dtype=np.uint8)
            for key, a, b in split_hot(text, anchor, 0, len(piece) - LENGTH + 1):
                part = piece[a : b + LENGTH - 1]
                rows.append((anchor, name, a, key, digest(part), n, part))
        yield _table(rows, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), ["anchor", "name", "at", "key", "part", "n", "piece"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the single windows of parts."""
    for batch in batches:
        rows = []
        for anchor, name, at, n, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "name", "at", "n", "piece")), strict=True):
            rows += [(anchor, name, at + a, digest(piece[a : a + LENGTH]), n) for a in range(len(piece) - LENGTH + 1)]
        yield _table(rows, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()), ["anchor", "name", "at", "window", "n"])


def _table(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """Of each piece of a shard: which of its windows also start elsewhere in the shard."""
    length = np.array([len(p) for p in pieces])
    begin = np.cumsum(length + 1) - length - 1
    data = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    t = data.astype(np.int64) + 2
    t[begin + length] = 1
    t = np.append(t, 0)
    data = np.append(data, np.uint8(0))
    sa = suffix_array(t, 258)
    del t
    room = np.zeros(len(sa), dtype=np.int64)
    for b, n in zip(begin.tolist(), length.tolist(), strict=True):
        room[b : b + n] = np.arange(n, 0, -1)
    same = np.flatnonzero(common_prefixes(data, sa, room, LENGTH) >= LENGTH)
    del room
    hit = np.zeros(len(sa), dtype=bool)
    before = np.empty(len(sa), dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    hit[same] = True
    hit[before[same]] = True
    return [hit[b : b + n - LENGTH + 1] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of covered bytes (start, end) of a piece, from its repeated windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), (edge[1::2] + LENGTH - 1).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_RUN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RUNS = "key long, name binary, runs array<struct<start:long,end:long>>"


def _shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """Partition (key, name, piece, n) sorted by key and name -> covered runs of each distinct piece. A shard ends with a key, and when it has shard bytes."""
    whole: list[tuple] = []  # of keys with one piece
    held: list[list] = []  # key, name, piece, occurs more than once
    size = 0
    group: list[list] = []

    def close() -> None:
        nonlocal size
        if len(group) > 1:
            held.extend(group)
            size += sum(len(x[2]) for x in group)
        elif group and group[0][3]:
            whole.append((group[0][0], group[0][1], [{"start": 0, "end": len(group[0][2])}]))
        group.clear()

    for batch in batches:
        for key, name, piece, n in zip(batch.column("key").to_pylist(), batch.column("name").to_pylist(), batch.column("piece").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if group and group[-1][0] == key:
                if group[-1][1] == name:
                    group[-1][3] = True
                    continue
            else:
                close()
                if size >= shard:
                    yield _found(held)
                    held, size = [], 0
            group.append([key, name, piece, n > 1])
        if len(whole) > 10_000:
            yield _table(whole, (pa.int64(), pa.binary(), pa.list_(_RUN)), ["key", "name", "runs"])
            whole = []
    close()
    if held:
        yield _found(held)
    if whole:
        yield _table(whole, (pa.int64(), pa.binary(), pa.list_(_RUN)), ["key", "name", "runs"])


def comparable(keys: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Which pieces may share a window with another piece of their key.

    A window holds its anchor and LENGTH - KMER more bytes, so pieces that share one have the same half of these before the
    anchor or behind it. Where the key isn't the anchor's hash, nothing is ruled out.
    """
    half = (LENGTH - KMER) // 2
    length = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    end = np.cumsum(length)
    begin = end - length
    h = prefix_hash(data)
    back = powers(len(data) + 1)[1]
    found = np.flatnonzero(mix((h[KMER:] - h[:-KMER]) * back[: len(h) - KMER]).view(np.int64) == keys.repeat(length)[: len(h) - KMER])
    found = np.append(found, len(data))
    at = found[np.searchsorted(found, begin)]
    keep = at + KMER > end
    for lo in (at - half, at + KMER):
        some = np.flatnonzero(~(at + KMER > end) & (lo >= begin) & (lo + half <= end))
        value = (h[lo[some] + half] - h[lo[some]]) * back[lo[some]]
        order = np.lexsort((value, keys[some]))
        same = (value[order][1:] == value[order][:-1]) & (keys[some][order][1:] == keys[some][order][:-1])
        keep[some[order[1:][same]]] = True
        keep[some[order[:-1][same]]] = True
    return keep


def _found(held: list[list]) -> pa.RecordBatch:
    keep = comparable(np.array([x[0] for x in held], dtype=np.int64), [x[2] for x in held])
    hits = iter(repeated_windows([x[2] for x, k in zip(held, keep.tolist(), strict=True) if k]) if keep.any() else ())
    rows = []
    for (key, name, piece, several), k in zip(held, keep.tolist(), strict=True):
        hit = next(hits) if k else None
        covered = [(0, len(piece))] if several else spans(hit) if k else []
        if covered:
            rows.append((key, name, [{"start": a, "end": b} for a, b in covered]))
    return _table(rows, (pa.int64(), pa.binary(), pa.list_(_RUN)), ["key", "name", "runs"])


def _sharded(pieces: DataFrame, shard: int) -> DataFrame:
    """(key, name, runs) of pieces(key, name, piece, n)."""
    return pieces.repartition(spread(pieces.sparkSession), "key").sortWithinPartitions("key", "name").mapInArrow(tidy(lambda b: _shards(b, shard)), _RUNS)


def _above(rows: DataFrame, key: str, name: str, hot: int) -> DataFrame:
    """Keys of rows with more than hot different names."""
    return materialise(rows.groupBy(key, name).agg(F.lit(1).alias("one")).groupBy(key).agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > hot).select(key))


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys.hint("merge")


def _moved(runs: str, by: str) -> Column:
    return F.transform(runs, lambda r: F.struct((r["start"] + F.col(by)).alias("start"), (r["end"] + F.col(by)).alias("end")))


def _covered(folded: DataFrame, hot: int, shard: int) -> DataFrame:
    """(anchor, name, runs): what of each different piece is repeated; folded(anchor, name, piece, n, many)."""
    plain = [F.col("anchor").alias("key"), "name", "piece", "n"]
    above = _above(folded.where("many"), "anchor", "name", hot)
    if above.isEmpty():
        return materialise(_sharded(folded.select(*plain), shard).withColumnRenamed("key", "anchor"))
    few = _small(above)
    out = _sharded(folded.join(few, "anchor", "left_anti").select(*plain), shard).withColumnRenamed("key", "anchor")
    different = folded.where("many").join(few, "anchor").groupBy("anchor", "name").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))
    parts = materialise(different.select("anchor", "name", "n", "piece").mapInArrow(tidy(_parts), _PART))
    crowded = _above(parts, "key", "part", hot)
    found = _sharded(parts.join(_small(crowded), "key", "left_anti").select("key", F.col("part").alias("name"), "piece", "n"), shard)
    found = parts.drop("piece", "n").join(found.withColumnRenamed("name", "part"), ["key", "part"]).select("anchor", "name", _moved("runs", "at").alias("runs"))
    windows = materialise(parts.join(_small(crowded), "key", "left_semi").mapInArrow(tidy(_windows), "anchor long, name binary, at long, window binary, n long"))
    again = materialise(windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"))
    single = windows.join(again, "window", "left_semi").select("anchor", "name", F.array(F.struct(F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))).alias("runs"))
    split = found.unionByName(single).groupBy("anchor", "name").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return materialise(out.unionByName(split))


_CUT = "cls binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for cls, packed, runs in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            text, kept, at, removed, count, last = unpack(packed), [], 0, 0, 0, -1
            for a, b in sorted((r["start"], r["end"]) for r in runs):
                if a > last:  # runs that touch are one
                    count += 1
                if b > at:
                    kept.append(text[at : max(at, a)])
                    removed += b - max(at, a)
                    at = b
                last = max(last, b)
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((cls, removed, count, hashlib.sha256(left).hexdigest(), left))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cls", "n_removed", "n_spans", "kept_sha256", "kept"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _cut leaves, as characters. Decoded by the same worker: a step of its own would be a second worker for each task."""
    for batch in _cut(batches):
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()], pa.string())], ["cls", "kept"])


def _half(c: str) -> Column:
    """128 bits of a digest."""
    return F.substring(c, 1, 16)


def repeats(docs: DataFrame, hot: int = HOT, shard: int = SHARD, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = _cut, schema: str = _CUT) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows(doc_id, cls, n_bytes) of docs(doc_id, text); cuts(cls, whole, and what else cut makes) of the classes that lose bytes, whole ones (texts that occur twice) without further values."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("cls"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")))
    whole = materialise(rows.where(F.col("n_bytes") >= LENGTH).groupBy("cls").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("cls"))
    found = docs.mapInArrow(tidy(_anchored), "cls binary, n_bytes long, anchors array<long>, firsts array<int>")
    once = materialise(found.where("size(anchors) > 0").dropDuplicates(["cls"]))
    ends = F.concat(F.slice("firsts", 2, F.greatest(F.size("firsts") - 1, F.lit(0))), F.array((F.col("n_bytes") - LENGTH + 1).cast("int")))
    each = once.select("cls", F.explode(F.arrays_zip("anchors", "firsts", ends.alias("lasts"))).alias("x"))
    # half of the digest, and both ends in one number: this is the table with the most rows
    ends = F.shiftleft(F.col("x.firsts").cast("long"), 32) + F.col("x.lasts")
    each = each.select(F.col("x.anchors").alias("anchor"), _half("cls").alias("half"), ends.alias("ends"))
    # counts are summed before the shuffle, and the join can be split where an anchor has many occurrences; a window can't
    counts = materialise(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    counted = each.join(counts.hint("merge"), "anchor")
    spots = materialise(counted.groupBy("half").agg(F.collect_list(F.struct("anchor", "ends", "n")).alias("spots")))
    discard(once, counts)
    texts = docs.mapInArrow(tidy(_texts), "cls binary, half binary, text binary").dropDuplicates(["half"])
    pieces = materialise(texts.join(spots, "half").select("cls", "text", "spots").mapInArrow(tidy(lambda b: _pieces(b, hot)), _PIECE))
    discard(spots)
    covered = _covered(pieces.where("piece is not null").select("anchor", "name", "piece", "n", "many"), hot, shard)
    runs = pieces.where("first is not null").select("cls", "anchor", "name", "first").join(covered, ["anchor", "name"])
    runs = runs.select("cls", _moved("runs", "first").alias("runs")).groupBy("cls").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    once = pieces.where("text is not null").select("cls", "text").join(runs, "cls").join(whole, "cls", "left_anti")
    cuts = once.mapInArrow(tidy(cut), schema).withColumn("whole", F.lit(False))
    return rows, cuts.unionByName(whole.withColumn("whole", F.lit(True)), allowMissingColumns=True)


def removed(docs: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty: 0 bytes, and the digest of nothing. Texts under 200 bytes lose nothing. Repeated rows are copies:
    with 200 bytes or more they lose all. A null id is an id like any other. An empty table gives no rows. Other columns are
    ignored.
    """
    rows, cuts = repeats(docs, hot, shard)
    # stored before it is joined, so that the join can be split where a text has many copies; short texts lose nothing and meet nowhere
    cuts = materialise(cuts.drop("kept"))
    long = F.col("n_bytes") >= LENGTH
    out = rows.where(long).join(cuts, "cls", "left").unionByName(rows.where(~long), allowMissingColumns=True)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("cls")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of text, and n_chars, where there is one, counted anew.

    A cut inside a character drops its bytes. No row is dropped; a null text stays null.
    """
    _, cuts = repeats(docs, cut=_cut_texts, schema="cls binary, kept string")
    cuts = materialise(cuts.select(F.col("cls").alias("cut_cls"), F.when(F.col("whole"), F.lit("")).otherwise(F.col("kept")).alias("cut_text")))
    # texts that can't lose anything take no part in the join
    long = F.octet_length("text") >= LENGTH
    own = docs.where(long).withColumn("own_cls", F.unhex(F.sha2("text", 256))).join(cuts, F.col("own_cls") == F.col("cut_cls"), "left")
    changed = F.col("cut_cls").isNotNull()
    own = own.select(*[F.when(changed, F.col("cut_text") if c == "text" else F.length("cut_text").cast(t)).otherwise(F.col(c)).alias(c) if c in ("text", "n_chars") else F.col(c) for c, t in docs.dtypes])
    return own.unionByName(docs.where(~F.coalesce(long, F.lit(False))))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
