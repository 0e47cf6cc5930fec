"""Two-stage suffix sorting of a block of bytes, with array operations.

A suffix is of type S if it is smaller than its successor, else of type L.
Stage one sorts the S suffixes alone, by their first ``DEPTH`` bytes.  Stage two
induces the L suffixes: going through the buckets of first bytes upwards, each
suffix places the one before it, if that is of type L, at the end of the L part
of its bucket; the L part of a bucket precedes its S part.  The order is that
of the first ``DEPTH`` bytes at least, enough for common prefixes below it.
"""

from __future__ import annotations

import numpy as np

DEPTH = 56


def eight_bytes(t: np.ndarray, pad: int = 64) -> np.ndarray:
    """The eight bytes from every position on, as one number; zeros after the end."""
    x = np.zeros(len(t) + pad, np.uint64)
    x[: len(t)] = t
    for step in (1, 2, 4):
        out = x << np.uint64(8 * step)
        out[:-step] |= x[step:]
        x = out
    return x


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Type S: the first byte that differs from its successor is smaller."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    first = np.minimum.accumulate(differs[::-1])[::-1]
    inner = first < n - 1
    at = first[inner]
    out[: n - 1][inner] = t[at] < t[at + 1]
    return out


def sorted_directly(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions by their first DEPTH bytes; only ties go on to the next eight."""
    order = at[np.argsort(keys[at], kind="stable")]
    group = np.concatenate([[0], np.cumsum(keys[order[1:]] != keys[order[:-1]])]) if len(order) else order
    for offset in range(8, DEPTH, 8):
        if not len(order):
            break
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        part, g = order[tied], group[tied]
        key = keys[part + offset]
        again = np.lexsort((key, g))
        order[tied] = part[again]
        key = key[again]
        fresh = np.zeros(len(order), bool)
        fresh[1:] = group[1:] != group[:-1]
        inside = np.zeros(len(tied), bool)
        inside[1:] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        fresh[tied] |= inside
        group = np.cumsum(fresh)
    return order


def suffix_order(t: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """All positions of t by the first DEPTH bytes of their suffixes."""
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    keys = eight_bytes(t) if keys is None else keys
    is_s = smaller_than_next(t)
    direct = sorted_directly(np.flatnonzero(is_s), keys)
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    parts = []
    for c in range(256):
        own = direct[bounds[c] : bounds[c + 1]]
        if not waiting[c] and not len(own):
            continue
        level = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        larger = []
        while len(level):
            larger.append(level)
            before = level[level > 0] - 1
            level = before[(t[before] == c) & ~is_s[before]]
        scan = np.concatenate([*larger, own])
        parts.append(scan)
        before = scan[scan > 0] - 1
        before = before[~is_s[before] & (t[before] > c)]
        if len(before):
            chars = t[before]
            by = np.argsort(chars, kind="stable")
            cut = np.flatnonzero(np.diff(chars[by])) + 1
            for piece in np.split(before[by], cut):
                waiting[t[piece[0]]].append(piece)
        waiting[c] = []
    return np.concatenate(parts)


def reaches(order: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Whether each position shares ``width`` bytes (8 to DEPTH) with the one before it."""
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = True
        for offset in [*range(0, width - 7, 8), width - 8]:
            k = keys[order + offset]
            same[1:] &= k[1:] == k[:-1]
    return same
