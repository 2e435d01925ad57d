"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard in a task."""

from __future__ import annotations

import numpy as np

#: Buckets are walked one by one with array operations; with more than this many for the length, plain lists are faster.
MOST_BUCKETS = 2048


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, the sentinel, is."""
    n = len(s)
    small = np.ones(n, bool)
    if n > 1:
        differ = np.flatnonzero(s[:-1] != s[1:])
        # an equal run takes the type of its end
        nearest = differ[np.searchsorted(differ, np.arange(n - 1))] if len(differ) else np.zeros(0, int)
        small[:-1] = s[nearest] < s[nearest + 1]
    return small


def induce(s: np.ndarray, small: np.ndarray, size: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of leftmost-smaller suffixes induces; walks the buckets, each with a few array operations."""
    n, k = len(s), len(size)
    ends = np.cumsum(size)
    starts = ends - size
    sa = np.full(n, -1, np.int64)
    c = s[lms]
    order = np.argsort(c, kind="stable")
    seeds = np.bincount(c, minlength=k)
    first = ends - seeds  # of the seeds in their bucket
    before = np.cumsum(seeds) - seeds
    sa[first[c[order]] + np.arange(len(lms)) - before[c[order]]] = lms[order]
    head = starts.copy()

    def push(seg: np.ndarray) -> None:
        p = seg[seg > 0] - 1
        p = p[~small[p]]
        if len(p):
            to = s[p]
            o = np.argsort(to, kind="stable")
            to, p = to[o], p[o]
            new = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            many = np.diff(np.r_[new, len(to)])
            sa[np.repeat(head[to[new]] - new, many) + np.arange(len(to))] = p
            head[to[new]] += many

    used = np.flatnonzero(size).tolist()
    for b in used:
        at = int(starts[b])
        while at < head[b]:
            seg = sa[at : head[b]]
            at = int(head[b])
            push(seg)
        if seeds[b]:
            push(sa[first[b] : ends[b]])
    tail = ends.copy()

    def pull(seg: np.ndarray) -> None:
        p = seg[::-1]
        p = p[p > 0] - 1
        p = p[small[p]]
        if len(p):
            to = s[p]
            o = np.argsort(to, kind="stable")
            to, p = to[o], p[o]
            new = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            many = np.diff(np.r_[new, len(to)])
            sa[np.repeat(tail[to[new]] - 1 + new, many) - np.arange(len(to))] = p
            tail[to[new]] -= many

    for b in reversed(used):
        at = int(ends[b])
        while at > tail[b]:
            seg = sa[tail[b] : at]
            at = int(tail[b])
            pull(seg)
        if head[b] > starts[b]:
            pull(sa[starts[b] : head[b]])
    sa[0] = n - 1  # nothing precedes the sentinel's suffix
    return sa


def induce_lists(s: list[int], small: list[bool], starts: list[int], ends: list[int], lms: list[int]) -> list[int]:
    """The same on plain lists, for many small buckets."""
    n = len(s)
    sa = [-1] * n
    tail = ends.copy()
    for i in reversed(lms):
        b = s[i]
        tail[b] = t = tail[b] - 1
        sa[t] = i
    head = starts.copy()
    for i in sa:
        if i > 0:
            i -= 1
            if not small[i]:
                b = s[i]
                h = head[b]
                sa[h] = i
                head[b] = h + 1
    tail = ends.copy()
    for k in range(n - 1, -1, -1):
        i = sa[k]
        if i > 0:
            i -= 1
            if small[i]:
                b = s[i]
                tail[b] = t = tail[b] - 1
                sa[t] = i
    sa[0] = n - 1
    return sa


def names_of(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each leftmost-smaller substring, in text order, equal substrings alike; ordered are their starts, sorted."""
    n, m = len(s), len(lms)
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(m)
    length = np.diff(np.r_[lms, n - 1]) + 1
    at = place[ordered]
    a, b, la, lb = ordered[:-1], ordered[1:], length[at[:-1]], length[at[1:]]
    same = la == lb
    left, k = np.flatnonzero(same), 0
    while len(left):
        bad = s[a[left] + k] != s[b[left] + k]
        same[left[bad]] = False
        k += 1
        left = left[~bad]
        left = left[la[left] > k]
    rank = np.cumsum(np.r_[0, ~same])
    names = np.empty(m, np.int64)
    names[at] = rank
    return names, int(rank[-1]) + 1


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of s in order. s ends in a 0 that occurs nowhere else; its values are under k."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(s, minlength=k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    if k <= MOST_BUCKETS or k * 50 <= n:
        run = lambda order: induce(s, small, size, order)
    else:
        ends = np.cumsum(size)
        args = s.tolist(), small.tolist(), (ends - size).tolist(), ends.tolist()
        run = lambda order: np.asarray(induce_lists(*args, order.tolist()), np.int64)
    sa = run(lms)
    ordered = sa[is_lms[sa]]
    names, many = names_of(s, lms, ordered)
    if many < len(lms):
        ordered = lms[suffix_array(names, many)]
    return run(ordered)


def shared_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray, stop: int, most: int) -> np.ndarray:
    """Permuted common prefixes: for each suffix in text order, what it shares with its neighbour before in the suffix array, up to `most`.

    Only the first counts[i] suffixes of each text from starts[i] are looked at, the texts side by side: a suffix shares at least what the one before it shares, less one.
    Values up to `stop` end a text and match nothing.
    """
    n = len(s)
    before = np.full(n, n - 1, np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int16)
    padded = np.r_[s, np.zeros(most + 1, s.dtype)]
    shared = np.zeros(len(starts), np.int64)
    for j in range(int(counts.max()) if len(counts) else 0):
        on = np.flatnonzero(counts > j)
        i = starts[on] + j
        o = before[i]
        h = np.maximum(shared[on] - 1, 0)
        left = np.flatnonzero(h < most)
        while len(left):
            x = padded[i[left] + h[left]]
            left = left[(x == padded[o[left] + h[left]]) & (x > stop)]
            h[left] += 1
            left = left[h[left] < most]
        shared[on] = h
        plcp[i] = h
    return plcp
