"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The symbols of a shard are classified as larger (L) or smaller (S) than what follows; leftmost-smaller (LMS) substrings
are sorted and named, the string of names is sorted recursively, and the order of all suffixes is induced from that of
the LMS suffixes in two linear scans over the buckets: L suffixes from left to right, S suffixes from right to left.
Within a bucket all entries of one generation are moved at once, and there are as many generations as a symbol repeats
in a row.

In the strings of names buckets are nearly as many as symbols, so there is nothing to move at once; those levels order
a suffix by its symbols up to the next LMS position and then by that position's rank, which is the same induction
written as a sort.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one.  The last symbol counts as smaller."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    step = np.append(step, 1)
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _tail_ranks(text: np.ndarray, small: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks (with ties) of the substrings from start to end, both included, in suffix order.

    Symbols carry their class in the lowest bit, so no substring that ends at an LMS position is a prefix of another.
    """
    bits = max(2, int(text.max()).bit_length() + 2)
    per = 63 // bits
    coded = np.concatenate([(text.astype(np.uint64) << np.uint64(1) | small) + np.uint64(1), np.zeros(per, np.uint64)])
    length = end - start + 1
    rank = np.zeros(len(start), np.int64)
    active, at = np.arange(len(start)), 0
    while len(active):
        key = np.zeros(len(active), np.uint64)
        for k in range(per):
            place = start[active] + at + k
            symbol = np.where(at + k < length[active], coded[np.minimum(place, len(coded) - 1)], 0)
            key = key << np.uint64(bits) | symbol.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        if at:
            order = order[np.argsort(rank[active][order], kind="stable")]
        k, r = key[order], rank[active][order]
        group = np.append(True, r[1:] != r[:-1])
        new = group.copy()
        new[1:] |= k[1:] != k[:-1]
        places = np.arange(len(order))
        base = np.maximum.accumulate(np.where(group, places, 0))
        first = np.maximum.accumulate(np.where(new, places, 0))
        rank[active[order]] = r + first - base
        at += per
        # those that go on and are not alone
        alone = new & np.append(new[1:], True)
        left = active[order[~alone]]
        active = left[length[left] > at]
    return rank


def suffix_array(text: np.ndarray, buckets: int = 0) -> np.ndarray:
    """The suffix array of a string whose last symbol is its unique smallest one.

    With ``buckets`` (the number of different symbols, if few) the order is induced bucket by bucket.
    """
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) == 1:
        lms_order = lms
    else:
        ends = np.append(lms[1:], n - 1)
        rank = _tail_ranks(text, small, lms, ends)
        names, named = np.unique(rank, return_inverse=True)
        if len(names) == len(lms):
            lms_order = lms[np.argsort(rank)]
        else:
            lms_order = lms[suffix_array(named)]
    return _induced(text, small, lms_order, buckets) if buckets else _by_tails(text, small, lms, lms_order)


def _by_tails(text: np.ndarray, small: np.ndarray, lms: np.ndarray, lms_order: np.ndarray) -> np.ndarray:
    n = len(text)
    start = np.arange(n - 1)
    after = np.searchsorted(lms, start, side="right")
    end = lms[np.minimum(after, len(lms) - 1)]
    place = np.empty(n, np.int64)
    place[lms_order] = np.arange(len(lms_order))
    rank = _tail_ranks(text, small, start, end)
    return np.concatenate([[n - 1], start[np.lexsort((place[end], rank))]])


def _induced(text: np.ndarray, small: np.ndarray, lms_order: np.ndarray, buckets: int) -> np.ndarray:
    n = len(text)
    counts = np.bincount(text, minlength=buckets)
    tails = np.cumsum(counts)
    heads = tails - counts
    larger = np.bincount(text[~small], minlength=buckets)
    out = np.full(n, -1, np.int64)
    s_starts = heads + larger  # in a bucket L suffixes come before S suffixes
    # LMS suffixes wait in order in the S part of their buckets
    of = text[lms_order]
    lms_in = np.split(lms_order[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=buckets))[:-1])

    free = heads.copy()
    for c in range(buckets):
        at = heads[c]
        while True:
            generation = out[at : free[c]]
            at = free[c]
            if not len(generation):
                break
            _place_left(text, small, generation, out, free)
        if len(lms_in[c]):
            _place_left(text, small, lms_in[c], out, free)
    last = tails.copy()
    for c in range(buckets - 1, -1, -1):
        at = tails[c]
        while True:
            generation = out[last[c] : at][::-1]
            at = last[c]
            if not len(generation):
                break
            _place_right(text, small, generation, out, last)
        part = out[heads[c] : s_starts[c]][::-1]
        if len(part):
            _place_right(text, small, part, out, last)
    out[0] = n - 1  # the smallest suffix
    return out


def _place_left(text, small, entries, out, free) -> None:
    """Move the L suffixes just before the entries to the fronts of their buckets, in order."""
    before = entries[entries > 0] - 1
    before = before[~small[before]]
    if not len(before):
        return
    of = text[before]
    order = np.argsort(of, kind="stable")
    before, of = before[order], of[order]
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(new, len(of)))
    out[np.repeat(free[of[new]] - new, sizes) + np.arange(len(of))] = before
    free[of[new]] += sizes


def _place_right(text, small, entries, out, last) -> None:
    """Move the S suffixes just before the entries to the backs of their buckets, in order."""
    before = entries[entries > 0] - 1
    before = before[small[before]]
    if not len(before):
        return
    of = text[before]
    order = np.argsort(of, kind="stable")
    before, of = before[order], of[order]
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(new, len(of)))
    out[np.repeat(last[of[new]] - 1 + new, sizes) - np.arange(len(of))] = before
    last[of[new]] -= sizes


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each position in text order: the symbols its suffix shares with the one sorted before it, up to ``limit``."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    padded = np.concatenate([text, np.zeros(limit + 1, text.dtype)])
    common = np.zeros(n, np.int64)
    active = np.flatnonzero(before >= 0)
    other = before[active]
    words = np.lib.stride_tricks.sliding_window_view(padded.view(np.uint8), 8 * text.itemsize)[:: text.itemsize]
    step, at = 8, 0
    if text.itemsize == 1:
        wide = np.ascontiguousarray(words).view(np.uint64).ravel()
        while len(active) and at + step <= limit:
            same = wide[active + at] == wide[other + at]
            common[active[~same]] = at  # the symbols of the last, unequal word are counted below
            active, other, at = active[same], other[same], at + step
        common[active] = at
        rest = np.flatnonzero(common < limit)
        rest = rest[before[rest] >= 0]
    else:
        rest = active
    while len(rest):
        place, match = common[rest], before[rest]
        same = padded[rest + place] == padded[match + place]
        rest = rest[same]
        common[rest] += 1
        rest = rest[common[rest] < limit]
    return common
