"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The induction of SA-IS goes through buckets of first bytes in order. All suffixes of a bucket that are known when the
scan reaches it induce their left neighbours together: those that start with a larger (smaller) byte are dealt stably to
their buckets, those with the same byte extend the bucket and induce in turn. That is the one-at-a-time order, in array
steps: linear work, at most a few hundred steps and one more for each byte of the longest run of equal bytes.
"""

from __future__ import annotations

import numpy as np

from driftline.llm.common import hash_bytes

_NONE = np.zeros(0, np.int64)


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """is_small of each suffix (smaller than the next one; the end counts as smallest), and leftmost-small positions."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    kind = np.zeros(len(ends), bool)
    kind[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
    small = np.repeat(kind, np.diff(np.append(-1, ends)))
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _deal(t: np.ndarray, p: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append p to the buckets of its bytes, keeping its order."""
    if not len(p):
        return
    c = t[p]
    p = p[np.argsort(c, kind="stable")]
    n = np.bincount(c, minlength=256)
    upto = np.cumsum(n)
    for k in np.flatnonzero(n).tolist():
        buckets[k].append(p[upto[k] - n[k]:upto[k]])


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _NONE


def induce(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, ordered as far as the order of `lms` (sorted by first byte) allows."""
    cut = np.searchsorted(t[lms], np.arange(257))
    large: list[np.ndarray] = [_NONE] * 256
    wait: list[list[np.ndarray]] = [[] for _ in range(256)]
    wait[t[-1]].append(np.array([len(t) - 1]))
    for c in range(256):
        out, push, cur = [], [], _join(wait[c])
        while len(cur):
            out.append(cur)
            p = cur[cur > 0] - 1
            b = t[p]
            push.append(p[b > c])
            cur = p[b == c]
        large[c] = _join(out)
        push.append(lms[cut[c]:cut[c + 1]] - 1)
        _deal(t, _join(push), wait)
    small: list[np.ndarray] = [_NONE] * 256
    wait = [[] for _ in range(256)]
    for c in range(255, -1, -1):
        out, push, cur = [], [], _join(wait[c])
        while len(cur):
            out.append(cur)
            p = cur[cur > 0] - 1
            b = t[p]
            push.append(p[b < c])
            cur = p[b == c]
        small[c] = _join(out)[::-1]
        back = large[c][::-1]
        p = back[back > 0] - 1
        push.append(p[t[p] < c])
        _deal(t, _join(push), wait)
    return np.concatenate([x for c in range(256) for x in (large[c], small[c])])


def _double(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: the length of the prefix that is in order doubles each round."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    held = names[order]
    new = np.ones(m, bool)
    new[1:] = held[1:] != held[:-1]
    rank = np.empty(m + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0)) + 1
    rank[m] = 0
    reach = 1
    while True:
        tied = ~new | ~np.append(new[1:], True)
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        i = order[at]
        follow = rank[np.minimum(i + reach, m)]
        inner = np.lexsort((follow, rank[i])) if m >= 1 << 21 else np.sort(rank[i] << 42 | follow << 21 | np.arange(len(i))) & ((1 << 21) - 1)
        i, follow = i[inner], follow[inner]
        order[at] = i
        old = rank[i]
        first = np.ones(len(at), bool)
        first[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        new[at] = first
        rank[i] = np.maximum.accumulate(np.where(first, at, 0)) + 1
        reach *= 2
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of the bytes `t` in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    _, lms = classify(t)
    if not len(lms):
        return induce(t, lms)
    sa = induce(t, lms[np.argsort(t[lms], kind="stable")])          # sorts the substrings between leftmost-small positions
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = sa[mark[sa]]
    upto = np.append(lms[1:] + 1, n)
    at = np.searchsorted(lms, ordered)
    h = hash_bytes(t, ordered, upto[at])
    length = upto[at] - ordered
    new = np.ones(len(at), np.int64)
    new[1:] = (h[1:] != h[:-1]) | (length[1:] != length[:-1])
    name = np.cumsum(new) - 1
    if name[-1] + 1 == len(lms):
        return induce(t, ordered)
    names = np.empty(len(lms), np.int64)
    names[at] = name
    # the reduced string: the same method again while its letters fit a byte, else by doubling
    order = suffix_array(names.astype(np.uint8)) if name[-1] < 256 else _double(names)
    return induce(t, lms[order])


def common_prefixes(t: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """plcp[i]: bytes that suffix i shares with its predecessor in `sa`, at most room[i] and the predecessor's room.

    `room` falls by one with each position and starts anew at 0. Only irreducible positions (whose left neighbours
    differ, or that begin a piece) are compared, eight bytes at a time; each other one has its left neighbour's value less one.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    begin = np.ones(n, bool)
    begin[1:] = room[1:] != room[:-1] - 1
    own = begin | (phi <= 0)
    rest = np.flatnonzero(~own)
    own[rest] = begin[phi[rest]] | (t[rest - 1] != t[phi[rest] - 1])
    at = np.flatnonzero(own)
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(phi[at] >= 0)
    a, b = at[live], phi[at[live]]
    most = np.minimum(room[a], room[b])
    padded = np.append(t, np.zeros(8, np.uint8))
    word = np.ndarray((n,), "<u8", padded.tobytes(), strides=(1,))
    have = np.zeros(len(live), np.int64)
    todo = np.flatnonzero(most > 0)
    while len(todo):
        x = word[a[todo] + have[todo]] ^ word[b[todo] + have[todo]]
        same = x == 0
        low = x & (~x + np.uint64(1))
        have[todo] += np.where(same, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        todo = todo[same & (have[todo] < most[todo])]
    value[live] = np.minimum(have, most)
    last = np.cumsum(own) - 1
    return np.maximum(value[last] - (np.arange(n) - at[last]), 0)
