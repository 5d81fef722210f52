"""Suffix arrays by induced sorting, in vectorised steps, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (S); t ends in a unique smallest value."""
    n = len(t)
    differ = np.empty(n, dtype=bool)
    differ[:-1] = t[:-1] != t[1:]
    differ[-1] = True
    # an equal pair has the kind of the first pair after it that differs
    at = np.minimum.accumulate(np.where(differ, np.arange(n), n)[::-1])[::-1]
    small = np.empty(n, dtype=bool)
    small[:-1] = t[:-1] < t[1:]
    small[-1] = True
    return small[at]


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted values: the distinct ones, how often each occurs, and each item's number within its value."""
    inner = np.flatnonzero(c[1:] != c[:-1])
    edge = np.empty(len(inner) + 2, dtype=np.int64)
    edge[0], edge[-1] = 0, len(c)
    np.add(inner, 1, out=edge[1:-1])
    count = edge[1:] - edge[:-1]
    return c[edge[:-1]], count, np.arange(len(c)) - edge[:-1].repeat(count)


def _blocks(far: np.ndarray) -> list[tuple[int, int]]:
    """Runs of buckets (first, last + 1) such that what a run induces lies beyond it: far[c] is the nearest bucket above c that c induces into."""
    far = np.minimum.accumulate(far[::-1])[::-1].tolist()
    out, c, n = [], 0, len(far)
    while c < n:
        out.append((c, min(far[c], n)))
        c = far[c]
    return out


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, kinds: int) -> np.ndarray:
    """The order of all suffixes that follows from the order of the leftmost S ones.

    Buckets are the first characters. The scan takes a run of buckets at a time in which no bucket induces into another, so
    the run is complete but for suffixes that repeat their first character (these follow in waves), and induces the
    predecessors of all its suffixes at once. Each suffix is placed once and read once for each pass. Alphabets may be as
    large as the text, as those of names are.
    """
    n = len(t)
    count = np.bincount(t, minlength=kinds)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, dtype=np.int64)
    first = t[lms]
    order = np.argsort(first, kind="stable")
    c, k, within = _runs(first[order])
    sa[(end[c] - k).repeat(k) + within] = lms[order]
    same = np.zeros(n, dtype=bool)  # the suffix begins as the next one does
    same[:-1] = t[:-1] == t[1:]
    wave = np.zeros(kinds + 1, dtype=np.int64)
    wave[1:] = np.cumsum(np.bincount(t[same], minlength=kinds) > 0)
    wave = wave.tolist()
    lower, upper = start.tolist(), end.tolist()

    def placed(j: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """j, in the order of the scan, at the next free places of their buckets; in the order of the buckets."""
        c = t[j]
        o = np.argsort(c, kind="stable")
        j = j[o]
        c, k, within = _runs(c[o])
        base = at[c].repeat(k)
        sa[base + within if step > 0 else base - 1 - within] = j
        at[c] += step * k
        return j

    def scan(kind: np.ndarray, at: np.ndarray, step: int, lo: int, hi: int) -> None:
        """Places what the buckets lo <= c < hi induce among suffixes of a kind."""
        a, b = lower[lo], upper[hi - 1]
        if a == b:
            return
        if wave[hi] > wave[lo]:
            j = sa[a:b][::step]
            while len(j):
                j = j[j > 0] - 1
                j = j[kind[j] & same[j]]
                if len(j):
                    j = placed(j, at, step)
        j = sa[a:b][::step]
        j = j[j > 0] - 1
        j = j[kind[j] & ~same[j]]
        if len(j):
            placed(j, at, step)

    large = ~small
    large[-1] = False
    far = np.full(kinds, kinds, dtype=np.int64)
    j = np.flatnonzero(large[:-1] & ~same[:-1])
    np.minimum.at(far, t[j + 1], t[j])
    head = start.copy()
    for lo, hi in _blocks(far):
        scan(large, head, 1, lo, hi)
    sa[(sa >= 0) & small[sa]] = -1
    sa[0] = n - 1  # the end of the text, before all
    # the same from the right: buckets are counted from the last one
    far = np.full(kinds, kinds, dtype=np.int64)
    j = np.flatnonzero(small[:-1] & ~same[:-1])
    np.minimum.at(far, kinds - 1 - t[j + 1], kinds - 1 - t[j])
    tail = end.copy()
    for lo, hi in _blocks(far):
        scan(small, tail, -1, kinds - hi, kinds - lo)
    return sa


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names, in the order of the text, of the substrings between leftmost S suffixes; equal ones, ends included, have one name."""
    n = len(t)
    at = np.empty(n, dtype=np.int64)
    at[lms] = np.arange(len(lms))
    length = (np.append(lms[1:] + 1, n) - lms)[at[ordered]]
    new = np.ones(len(lms), dtype=bool)
    new[1:] = length[1:] != length[:-1]
    i, k = np.flatnonzero(~new), 0
    while len(i):  # pairs of neighbours that agree so far
        differ = t[ordered[i] + k] != t[ordered[i - 1] + k]
        new[i[differ]] = True
        k += 1
        i = i[~differ]
        i = i[length[i] > k]
    names = np.empty(len(lms), dtype=np.int64)
    names[at[ordered]] = np.cumsum(new) - 1
    return names


def suffix_array(t: np.ndarray, kinds: int) -> np.ndarray:
    """Order of the suffixes of t (whole numbers below kinds, the last one 0 and no other 0).

    Suffixes are classified, the substrings between leftmost S suffixes are sorted by induction and named, the string of
    names, at most half as long, is sorted in the same way, and the order of all suffixes is induced from it.
    """
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    sa = induce(t, small, lms, kinds)
    ordered = sa[is_lms[sa]]
    del sa, is_lms
    names = _named(t, lms, ordered)
    kinds_of_names = int(names.max()) + 1
    if kinds_of_names < len(lms):
        ordered = lms[suffix_array(names, kinds_of_names)]
    del names
    return induce(t, small, ordered, kinds)


def common_prefixes(data: np.ndarray, sa: np.ndarray, room: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes up to cap: at each position, the length shared with the suffix that comes before it in the order.

    data: bytes; room: bytes that a suffix may use. Eight bytes are compared at a time, only where all before were equal.
    """
    n = len(data)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(n, dtype=np.int64)
    j = np.flatnonzero((phi >= 0) & (room > 0))
    limit = np.minimum(np.minimum(room[j], room[phi[j]]), cap)
    j = j[limit > 0]
    for k in range(0, cap, 8):
        a, b = np.ascontiguousarray(eight[j + k]).view(np.uint64)[:, 0], np.ascontiguousarray(eight[phi[j] + k]).view(np.uint64)[:, 0]
        x = a ^ b
        same = x == 0
        out[j[same]] = k + 8
        low = x[~same]
        # equal low bytes of the first word that differs
        out[j[~same]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8)
        j = j[same]
        if not len(j):
            break
    return np.minimum(np.minimum(out, cap), np.where(phi >= 0, np.minimum(room, room[phi]), 0))
