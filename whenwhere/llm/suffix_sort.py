"""The suffixes of one block in lexicographic order, by a difference cover; numpy only, used inside tasks.

A block is a buffer of byte fragments. The cover's sample strings of the block are ranked first. Then its suffixes are sorted by their first
v bytes; ties are compared in constant time by the ranks of the two sample strings that start at one distance d < v behind both
suffixes, however long the strings agree. What still ties is equal up to d + length - v + 1 bytes and is compared by the rank of its last v bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import arrowtext as A

WORD = 5  # bytes compared at a time, beside 24 bits of a group's number


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Colbourn and Ling's cover: 6r+4 residues modulo 24r**2 + 36r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


@lru_cache(maxsize=2)
def cover_tables(r: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The period, which residues are in the cover, and for two residues the least d that brings both into it."""
    v, d = difference_cover(r)
    inside = np.zeros(v, bool)
    inside[d] = True
    meet = np.full((v, v), v, np.int32)
    for step in range(v - 1, -1, -1):
        at = np.flatnonzero(inside[(np.arange(v) + step) % v])
        meet[np.ix_(at, at)] = step
    return v, inside, meet


class Bytes:
    """A buffer with prefix sums, from which any substring's fingerprint follows."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.n = n
        self.raw = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.words = np.ndarray((n + 1,), ">u8", self.raw, strides=(1,))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(A.BYTE_VALUE[raw] * A.powers(n), out=self.sums[1:])
        self.down = A.powers(n + 1, A.BASE_INVERSE)

    def prints(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]


def groups_of(new: np.ndarray) -> np.ndarray:
    return np.cumsum(new) - 1


def sort_strings(text: Bytes, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of ``length`` bytes at ``at`` within their groups, and where in it a new string begins.

    Groups are numbers; they keep their order. Strings that share a prefix skip it: its length is found by fingerprints against the group's first.
    """
    idx = np.argsort(group, kind="stable")
    new = np.ones(len(idx), bool)
    new[1:] = group[idx[1:]] != group[idx[:-1]]
    w = np.arange(len(idx))
    gid, depth = groups_of(new), np.zeros(len(idx), np.int64)
    rounds = 0
    while True:
        size = np.bincount(gid)
        keep = size[gid] > 1  # groups of two or more
        w, gid, depth = w[keep], gid[keep], depth[keep]
        if not len(w):
            return idx, new
        p = at[idx[w]]
        if rounds:  # those that are equal throughout are done
            whole = text.prints(p, length)
            head, gid = _regroup(gid)
            mixed = np.logical_or.reduceat(whole != whole[head][gid], head)[gid]
            w, depth, p, gid = w[mixed], depth[mixed], p[mixed], gid[mixed]
            if not len(w):
                return idx, new
        head, gid = _regroup(gid)
        if rounds > 1:
            depth = np.minimum.reduceat(_shared(text, p, head, gid, depth, length), head)[gid]
        rounds += 1
        take = np.minimum(WORD, length - depth)
        word = text.words[p + depth].astype(np.uint64) >> np.uint64(64 - 8 * WORD)
        word &= ~np.uint64(0) << (np.uint64(8) * (WORD - take).astype(np.uint64))
        key = gid.astype(np.uint64) << np.uint64(8 * WORD) | word
        o = np.argsort(key)
        key = key[o]
        idx[w] = idx[w][o]
        cut = np.ones(len(key), bool)
        cut[1:] = key[1:] != key[:-1]
        new[w] |= cut
        gid, depth = groups_of(cut), depth + take


def _regroup(gid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places of ascending groups, and the groups numbered without gaps."""
    new = np.ones(len(gid), bool)
    new[1:] = gid[1:] != gid[:-1]
    return np.flatnonzero(new), groups_of(new)


def _shared(text: Bytes, p: np.ndarray, head: np.ndarray, gid: np.ndarray, depth: np.ndarray, length: int) -> np.ndarray:
    """How many bytes each string shares with its group's first, at least ``depth`` and less than ``length``; by bisection on fingerprints."""
    sums, down = text.sums[p], text.down[p]
    q, q_sums, q_down = p[head][gid], sums[head][gid], down[head][gid]
    lo, hi = depth, np.full(len(p), length - 1)
    for _ in range(int(length).bit_length()):
        mid = (lo + hi + 1) >> 1
        fits = (text.sums[p + mid] - sums) * down == (text.sums[q + mid] - q_sums) * q_down
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, np.maximum(mid - 1, lo))
    return lo


def sort_ties(items: np.ndarray, new: np.ndarray, compare) -> tuple[np.ndarray, np.ndarray]:
    """Items sorted within their groups (which begin at ``new``) by a vectorised comparison; and where a new class begins.

    Groups whose members all equal their first are left as they are; the others are merged from the bottom up.
    """
    items, new = items.copy(), new.copy()
    head = np.flatnonzero(new)
    gid = groups_of(new)
    mixed = np.logical_or.reduceat(compare(items, items[head][gid]) != 0, head)[gid]
    w = np.flatnonzero(mixed)
    if not len(w):
        return items, new
    x = items[w]
    start = np.flatnonzero(np.diff(gid[w], prepend=-1))
    size = np.diff(np.append(start, len(w)))
    base, count = np.repeat(start, size), np.repeat(size, size)
    rel = np.arange(len(w)) - base
    width = 1
    while width < size.max():
        block = rel // width
        left = block % 2 == 0
        other = base + np.where(left, block + 1, block - 1) * width  # the sibling run
        stop = np.minimum(other + width, base + count)
        lo, hi = np.minimum(other, stop), stop.copy()
        while len(at := np.flatnonzero(lo < hi)):
            mid = (lo[at] + hi[at]) >> 1
            c = compare(x[mid], x[at])
            ahead = np.where(left[at], c < 0, c <= 0)
            lo[at], hi[at] = np.where(ahead, mid + 1, lo[at]), np.where(ahead, hi[at], mid)
        place = base + (block & ~1) * width + rel % width + np.maximum(lo - np.minimum(other, stop), 0)
        y = np.empty_like(x)
        y[place] = x
        x = y
        width *= 2
    items[w] = x
    tie = np.zeros(len(w), bool)
    tie[1:] = compare(x[1:], x[:-1]) == 0
    tie[start] = False
    new[w[~tie]] = True
    return items, new


def sort_block(text: Bytes, at: np.ndarray, anchor: np.ndarray, bucket: np.ndarray, samples: np.ndarray, sample_bucket: np.ndarray, sample_length: int, length: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's suffixes by their first ``length`` bytes within their buckets, and where a new string begins.

    ``samples`` are the cover's positions, counted from each fragment's anchor; every one within v bytes behind a suffix is there.
    """
    v, _, meet = cover_tables(r)
    order, new = sort_strings(text, at, bucket, v)
    size = np.bincount(groups_of(new))
    tied = np.flatnonzero(size[groups_of(new)] > 1)
    if not len(tied):
        return order, new
    sample_order, sample_new = sort_strings(text, samples, sample_bucket, sample_length)
    rank = np.full(text.n + 1, -1, np.int32)
    rank[samples[sample_order]] = groups_of(sample_new)
    residue = (at - anchor) % v
    ends = order[tied]
    end_order, end_new = sort_strings(text, at[ends] + (length - v), bucket[ends], v)
    end_rank = np.zeros(len(at), np.int32)
    end_rank[ends[end_order]] = groups_of(end_new)

    def compare(i, j):
        d = meet[residue[i], residue[j]]
        c = rank[at[i] + d] - rank[at[j] + d]
        return np.where(c == 0, end_rank[i] - end_rank[j], c)

    order[tied], new[tied] = sort_ties(order[tied], new[tied], compare)
    return order, new
