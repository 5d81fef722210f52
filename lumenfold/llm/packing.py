"""Packing documents into training sequences by order-preserving dynamic programming.

Documents stay in the order of their input partition. Windows of at most LENGTH tokens are cut at document ends,
sentence ends or, where none lies within LENGTH tokens, at a multiple of LENGTH. The cuts minimise padding plus
penalties: f(j) = penalty(j) + LENGTH - pos(j) + min over i of f(i) + pos(i), with pos(j) - pos(i) <= LENGTH, a sliding
minimum that a monotone queue gives in linear time. A window of exactly a power of two needs no padding, so a place that
far back is looked up for each smaller power: f(j) = penalty(j) + f(i). Of equal costs, the queue's longer window is taken.

Each task packs its own partition in steps of STEP tokens; the last window of a step is opened again in the next. There is
no shuffle, and memory is bounded by a step and the longest document. A rerun of a task gives the same rows. A
partition's last window may be padded, and sequence_id holds the partition's number, so both go with how the input is dealt.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

LENGTH = 2048
END = 1
#: Tokens of padding that a cut may save before it is worth it.
SENTENCE, ANYWHERE = 8, 256
STEP = 256 * LENGTH
VOCABULARY = "byte_bpe_50k"
_loaded: dict = {}


def _tokenizer(name: str, folder: str | None):
    """(fast encoder, full tokenizer, its special strings, does token i end a sentence, does it start with white space).

    The rank file holds the vocabulary and merges of the tokenizer file; it gives the same ids several times faster. Texts
    with a special token's string go through the tokenizer itself.
    """
    if (name, folder) not in _loaded:
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda x: os.path.join(folder, x)) if folder else public_tokenizers.path
        with open(path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        full = Tokenizer.from_file(path(f"{name}.json"))
        size = full.get_vocab_size()
        ends, blank = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, i in ranks.items():
            ends[i] = token[-1:] in (b".", b"!", b"?", b"\n")
            blank[i] = token[:1] in (b" ", b"\n", b"\t", b"\r")
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [x.content for x in full.get_added_tokens_decoder().values()]
        _loaded[name, folder] = fast, full, special, ends, blank
    return _loaded[name, folder]


def encode(text: str, name: str = VOCABULARY, folder: str | None = None) -> np.ndarray:
    fast, full, special, _, _ = _tokenizer(name, folder)
    if any(x in text for x in special):
        ids = full.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array([*ids, END], dtype="<u4")


def cut_points(ends: list[np.ndarray], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """(positions, penalties) at which a run of documents may be cut, from the sentence ends of each (the document's end last)."""
    positions = np.concatenate([np.zeros(1, np.int64), *ends])
    penalties = np.full(len(positions), SENTENCE, dtype=np.int64)
    penalties[np.cumsum([len(x) for x in ends])] = 0
    gap = np.diff(positions)
    if (gap > length).any():
        more = [np.arange(positions[i] + length, positions[i + 1], length) for i in np.flatnonzero(gap > length).tolist()]
        positions = np.concatenate([positions, *more])
        penalties = np.concatenate([penalties, *[np.full(len(x), ANYWHERE) for x in more]])
        order = np.argsort(positions, kind="stable")
        positions, penalties = positions[order], penalties[order]
    return positions.tolist(), penalties.tolist()


def best_cuts(pos: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """Cut positions, the first and last of pos included, with the least padding plus penalties."""
    n = len(pos)
    cost, back, key = [0] * n, [0] * n, [0] * n
    key[0] = pos[0]
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    place = {p: i for i, p in enumerate(pos)}
    find = place.get
    queue, head = [0], 0
    for j in range(1, n):
        p = pos[j]
        while p - pos[queue[head]] > length:
            head += 1
        i = queue[head]
        c = key[i] - p + length
        for w in powers:
            o = find(p - w)
            if o is not None and cost[o] < c:
                c, i = cost[o], o
        cost[j] = c = c + penalty[j]
        back[j] = i
        key[j] = k = c + p
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [pos[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(pos[j])
    return cuts[::-1]


class _Packer:
    def __init__(self, length: int, first: int, with_ids: bool):
        self.length, self.next, self.with_ids = length, first, with_ids
        self.docs: list[list] = []  # [doc_id, all tokens, tokens already out, rest of the sentence ends]
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0, stops])
        self.size += len(ids)

    def cut(self, over: bool) -> Iterator[tuple]:
        ends, base = [], 0
        for _, ids, out, stops in self.docs:
            ends.append(stops - out + base)
            base += len(ids) - out
        if not base:
            return
        cuts = best_cuts(*cut_points(ends, self.length), self.length)
        if not over:
            cuts.pop()  # the last window is opened again
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            left, offset = hi - lo, 0
            while left:
                doc = self.docs[0]
                n = min(left, len(doc[1]) - doc[2])
                piece = doc[1][doc[2] : doc[2] + n]
                row = (doc[0], doc[2], n, zlib.crc32(piece.tobytes()), len(doc[1]), self.next, offset)
                yield (*row, piece) if self.with_ids else row
                left, offset, doc[2] = left - n, offset + n, doc[2] + n
                if doc[2] == len(doc[1]):
                    self.docs.pop(0)
                else:
                    doc[3] = doc[3][doc[3] > doc[2]]
            self.next += 1
            self.size -= hi - lo


_COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.list_(pa.int64())}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=False)], list(_COLUMNS)[: len(rows[0])])


def _pack(batches: Iterator[pa.RecordBatch], length: int, step: int, name: str, folder: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    _, _, _, sentence, blank = _tokenizer(name, folder)
    packer = _Packer(length, TaskContext.get().partitionId() << 40, with_ids)
    rows: list[tuple] = []
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()), batch.column("text"), strict=True):
            ids = encode(text.as_py() or "", name, folder)
            inner = ids[:-1]
            stops = np.flatnonzero(sentence[inner[:-1]] & blank[inner[1:]]) + 1
            packer.add(doc_id.as_py(), ids, np.append(stops, len(ids)))
            if packer.size >= step:
                rows += packer.cut(False)
                if len(rows) >= (500 if with_ids else 20_000):
                    yield _batch(rows)
                    rows = []
    rows += packer.cut(True)
    if rows:
        yield _batch(rows)


def pack(docs: DataFrame, length: int = LENGTH, step: int = STEP, vocabulary: str = VOCABULARY, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids where asked for).

    A document's ids are the tokenizer's, then id 1; a null or empty text has that one id. Pieces of a sequence lie gapless
    from offset 0; a sequence holds at most length ids. folder: where the vocabulary files are, on every machine. Repeated
    rows and null ids are documents like any other. An empty table gives no rows. Other columns are ignored.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda x: _pack(x, length, step, vocabulary, folder, with_ids), schema)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
