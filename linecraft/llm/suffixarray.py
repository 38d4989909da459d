"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes (S if smaller than the next one, else L), sorts the leftmost-S
substrings, names them, sorts the reduced string of names and induces all suffixes from them.  The
scans over the bytes work bucket by bucket on whole arrays; the names, whose alphabet is as large as
their string, are sorted by doubling, also on whole arrays.
"""

from __future__ import annotations

import numpy as np

from .textops import mix


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type; the last symbol is the unique smallest."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(step, 1)[at] > 0
    return out


def _put(sa: np.ndarray, t: np.ndarray, edge: np.ndarray, what: np.ndarray, sign: int) -> None:
    """Append suffixes to their buckets in the order given, upwards or downwards."""
    c = t[what]
    order = np.argsort(c, kind="stable")
    c, what = c[order], what[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, count)
    sa[edge[c] + sign * rank] = what
    edge[c[first]] += sign * count


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from the order of the leftmost S-type ones."""
    n, k = len(t), int(t.max()) + 1
    size = np.bincount(t, minlength=k)
    ends = np.cumsum(size)
    heads = ends - size
    sa = np.full(n, -1, np.int64)
    n_lms = np.bincount(t[lms], minlength=k)
    tail = ends - 1
    _put(sa, t, tail.copy(), lms[::-1], -1)
    edge = heads.copy()
    for c in np.flatnonzero(size):
        done = heads[c]
        while done < edge[c]:
            batch = sa[done : edge[c]].copy()
            done = edge[c]
            before = batch[batch > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _put(sa, t, edge, before, 1)
        if n_lms[c]:
            batch = sa[ends[c] - n_lms[c] : ends[c]]
            before = batch[batch > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _put(sa, t, edge, before, 1)
    edge_l, edge = edge, tail.copy()
    for c in np.flatnonzero(size)[::-1]:
        done = tail[c]
        while done > edge[c]:
            batch = sa[edge[c] + 1 : done + 1][::-1].copy()
            done = edge[c]
            before = batch[batch > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _put(sa, t, edge, before, -1)
        batch = sa[heads[c] : edge_l[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[is_s[before]]
        if len(before):
            _put(sa, t, edge, before, -1)
    sa[0] = n - 1
    return sa


def _sort_names(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names (the last one unique and smallest), by doubling.

    A suffix's rank is the first place of its group of equal prefixes; a round splits the groups that
    are left by the ranks as far ahead as their prefixes reach.
    """
    n = len(s)
    size = np.bincount(s)
    rank = (np.cumsum(size) - size)[s]
    left, ahead = np.flatnonzero(size[s] > 1), 1
    while len(left):
        key = rank[left] * n + rank[left + ahead]
        order = np.argsort(key)
        left, key = left[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[left]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        place = np.arange(len(left))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[left] = old + first - np.maximum.accumulate(np.where(group, place, 0))
        alone = new & np.append(new[1:], True)
        left, ahead = left[~alone], ahead * 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small integers whose last symbol is the only 0."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    if t.max() < 1 << 16:
        t = t.astype(np.uint16)  # stable sorts of which go by digits
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, is_s, lms)
    ends = np.append(lms[1:], len(t) - 1) + 1
    sa = _induce(t, is_s, lms)
    at = np.full(len(t), -1, np.int64)
    at[lms] = np.arange(len(lms))
    order = at[sa]
    order = order[order >= 0]
    base, code = np.uint64(0x9E3779B97F4A7C15), mix(t.astype(np.uint64) + np.uint64(1))
    power = np.full(len(t) + 1, base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(code * power[:-1])])
    h = mix((sums[ends] - sums[lms]) * power[len(t) - lms]) + (ends - lms).astype(np.uint64)
    new = np.concatenate([[0], (h[order[1:]] != h[order[:-1]]).astype(np.int64)])
    names = np.cumsum(new)
    if names[-1] + 1 < len(lms):
        name = np.empty(len(lms), np.int64)
        name[order] = names
        order = _sort_names(name)
    return _induce(t, is_s, lms[order])


def common_prefixes(data: np.ndarray, seg_end: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi (the suffix before each one in order, -1 for the first) and the permuted common prefixes.

    ``data`` are bytes, ``seg_end[i]`` the end of i's segment, which no common prefix crosses.
    Only irreducible values, where the bytes before differ, are compared; each other one is one
    less than the value at the position before.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    irreducible = np.ones(n, bool)
    same = np.flatnonzero((phi[1:] > 0) & (phi[:-1] >= 0)) + 1
    same = same[(phi[same] == phi[same - 1] + 1) & (data[same - 1] == data[phi[same] - 1]) & (seg_end[same] == seg_end[same - 1]) & (seg_end[phi[same]] == seg_end[phi[same] - 1])]
    irreducible[same] = False
    i = np.flatnonzero(irreducible & (phi >= 0))
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1)).copy().view("<u8").ravel()
    j, room = phi[i], np.minimum(seg_end[i] - i, seg_end[phi[i]] - phi[i])
    found = np.zeros(len(i), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live):
        diff = eight[i[live] + found[live]] ^ eight[j[live] + found[live]]
        equal = diff == 0
        low = diff & (~diff + np.uint64(1))
        found[live] += np.where(equal, 8, np.floor(np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64) // 8)
        live = live[equal & (found[live] < room[live])]
    plcp = np.zeros(n, np.int64)
    plcp[i] = np.minimum(found, room)
    last = np.maximum.accumulate(np.where(irreducible, pos, 0))
    plcp = np.maximum(plcp[last] - (pos - last), 0)
    return phi, plcp
