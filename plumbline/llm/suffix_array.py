"""Suffix arrays in numpy: prefix doubling, common prefixes, and search of one array in another.

The text is a row of pieces, each of which ends suffixes that start in it.
"""

from __future__ import annotations

import numpy as np


#: Bits of a position in an integer that is sorted; three of them fit into one.
PLACE_BITS = 21


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian integer (zeros after the end)."""
    a = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    w = a[: n + 7] << np.uint64(8) | a[1:]
    w = w[: n + 5] << np.uint64(16) | w[2 : n + 7]
    return (w[: n + 1] << np.uint64(32) | w[4 : n + 5])[:n]


def _by_prefix(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(starts of suffixes in order of their first few bytes, where a new prefix begins in it, how many bytes that are)."""
    n = len(text)
    few = n < 1 << PLACE_BITS
    h = 5 if few else 8
    size = np.minimum(left, h)
    key = words8(text)
    if few:  # five bytes, how many there are, and the position in one integer
        key &= ~np.uint64(0) << (np.uint64(8) * (8 - size).astype(np.uint64))
        place = np.uint64(PLACE_BITS)
        key = key >> np.uint64(24) << np.uint64(24) | size.astype(np.uint64) << place | np.arange(n, dtype=np.uint64)
        key.sort()
        sa, key = (key & (np.uint64(1) << place) - np.uint64(1)).astype(np.int64), key >> place
        return sa, np.append(True, key[1:] != key[:-1]), h
    short = np.flatnonzero(left < h)
    key[short] &= ~np.uint64(0) << (np.uint64(8) * (h - left[short]).astype(np.uint64))
    sa = np.argsort(key, kind="stable") if text.all() else np.lexsort((size, key))  # a zero byte is no end
    key, size = key[sa], size[sa]
    return sa, np.append(True, (key[1:] != key[:-1]) | (size[1:] != size[:-1])), h


def _by_pair(first: np.ndarray, second: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, second, where a new pair begins) in order of first, second and at; at ascends, and all are n at most."""
    if n < 1 << PLACE_BITS:
        mask = (1 << PLACE_BITS) - 1
        key = first << 2 * PLACE_BITS | second << PLACE_BITS | at
        key.sort()
        pair = key >> PLACE_BITS
        return key & mask, pair & mask, np.append(True, pair[1:] != pair[:-1])
    pair = first << 32 | second
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    return at[order], second[order], np.append(True, pair[1:] != pair[:-1])


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int = 256) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes.  ends: the end of each position's piece.

    Larsson and Sadakane's refinement: after sorting by a first prefix, groups of equal ones
    are sorted by the rank of what follows, each round doubling the prefix; groups of one,
    and suffixes that are over, are left out of all later rounds.  What is sorted is put into
    one integer with its position, as long as the text has less than 2 ** PLACE_BITS bytes.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    left = (ends - np.arange(n)).astype(np.int64)
    sa, head, h = _by_prefix(text, left)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    open_ = ~(head & np.append(head[1:], True))
    slots, at = np.flatnonzero(open_), np.sort(sa[open_])  # places in the array, and suffixes, of groups of several
    while len(slots) and h < depth:
        beyond = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        who, beyond, head = _by_pair(rank[at], beyond, at, n)
        sa[slots] = who
        rank[who] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        # alike suffixes that are over stay in order of their positions
        open_ = ~(head & np.append(head[1:], True)) & (beyond > 0)
        slots, at = slots[open_], np.sort(who[open_])
        h *= 2
    return sa


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the first of eight bytes are zero."""
    n = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        n += x < np.uint64(1 << (64 - 8 * k)) if k < 8 else x == 0
    return n


def extended(w: np.ndarray, p: np.ndarray, q: np.ndarray, h: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Common prefixes of p and q, known to be h at least and wanted up to limit."""
    h = np.minimum(h, limit)
    live = np.flatnonzero(h < limit)
    n = len(w)
    while len(live):
        a, b = p[live] + h[live], q[live] + h[live]
        same = _same_bytes(w[np.minimum(a, n - 1)] ^ w[np.minimum(b, n - 1)])
        h[live] = np.minimum(h[live] + same, limit[live])
        live = live[(same == 8) & (h[live] < limit[live])]
    return h


def common_prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, sa: np.ndarray, most: int, least: int = 1) -> np.ndarray:
    """Of each suffix in sa with the one before it, up to most; suffixes of less than least bytes are passed over (zero).

    Kasai's way: a suffix has at least one byte less in common with its neighbour than the
    suffix one position before it had, so bytes are compared once.  That holds only if sa is in
    full order (its depth not less than the longest piece), equal suffixes by position.  All pieces (starts: their
    first positions) are gone through at the same time, one position a step.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    w = words8(text)
    lcp = np.zeros(n, np.int64)
    at = starts[np.argsort(-(ends[starts] - starts), kind="stable")]
    size = ends[at] - at - least + 1  # the suffixes that are wanted begin each piece
    h = np.zeros(len(at), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        p, h = at[:live] + t, np.maximum(h[:live] - 1, 0)
        rank = place[p]
        q = sa[np.maximum(rank - 1, 0)]
        limit = np.where(rank > 0, np.minimum(np.minimum(ends[p] - p, ends[q] - q), most), 0)
        h = extended(w, p, q, h, limit)
        lcp[rank] = h
    return lcp


def found_in(text: np.ndarray, ends: np.ndarray, sa: np.ndarray, other: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Whether other[at:at + width] is a prefix of a suffix in sa, by binary search; width is a multiple of 8."""
    if not len(sa) or not len(at):
        return np.zeros(len(at), bool)
    w, v = words8(text), words8(other)
    left = (ends - np.arange(len(text))).astype(np.int64)

    def below(mid: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the suffix is less than the string, it begins with the string)."""
        p, q = sa[mid], at[live]
        less, open_ = np.zeros(len(live), bool), np.arange(len(live))
        for k in range(0, width, 8):
            here = p[open_] + k
            room = left[p[open_]] - k
            x = np.where(room > 0, w[np.minimum(here, len(w) - 1)], 0)
            cut = np.clip(8 - room, 0, 8).astype(np.uint64)
            x = np.where((cut > 0) & (cut < 8), x & (~np.uint64(0) << (np.uint64(8) * (cut % np.uint64(8)))), x)
            y = v[q[open_] + k]
            done = (x != y) | (room < 8)
            less[open_[done]] = (x[done] < y[done]) | ((x[done] == y[done]) & (room[done] < 8))
            open_ = open_[~done]
            if not len(open_):
                break
        whole = np.zeros(len(live), bool)
        whole[open_] = True
        return less, whole

    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    live = np.arange(len(at))
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        less, _ = below(mid, live)
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    there = np.flatnonzero(lo < len(sa))
    out = np.zeros(len(at), bool)
    if len(there):
        out[there] = below(lo[there], there)[1]
    return out
