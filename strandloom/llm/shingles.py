"""Sets of word shingles as sorted 64-bit hashes, and SuperMinHash signatures of them, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandloom.llm.common import blocks, mix64, utf8_view

BLOCK_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**64, 64, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for at least n places."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for which, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table, filled = np.ones(size, np.uint64), 1
            while filled < size:
                step = np.uint64(pow(base, filled, 2**64))
                table[filled : 2 * filled] = table[:filled] * step
                filled *= 2
            _POWERS[which] = table
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, bounds: np.ndarray, fold: np.ndarray = _LOWER, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, lower-cased unless ``fold`` says otherwise, and the n+1 bounds of each row's words."""
    rows = len(bounds) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    text = fold[data]
    inside = ~_BREAK[text]
    full = bounds[1:] > bounds[:-1]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    first[bounds[:-1][full]] = True
    last[bounds[1:][full] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[text] * power[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array, k: int, block_bytes: int = BLOCK_BYTES):
    """Yield (first row, hashes, bounds): the distinct k-word shingles of each whole text, sorted by row and hash.

    Fewer than k words are one shingle of all words; no words, no shingle.
    """
    data, offsets = utf8_view(column)
    for start, end in blocks(offsets, block_bytes):
        own = offsets[start : end + 1]
        words, at = word_hashes(data[own[0] : own[-1]], own - own[0])
        n_words = np.diff(at)
        n = np.where(n_words > 0, np.maximum(1, n_words - k + 1), 0)
        row = np.repeat(np.arange(end - start), n)
        first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(len(row))
        used = np.minimum(n_words, k)[row]
        mixed = used.astype(np.uint64) * _PLACE[63]
        for t in range(k):
            if (n_words >= k).all():
                mixed += words[first + t] * _PLACE[t]
            else:
                there = np.flatnonzero(used > t)
                mixed[there] += words[first[there] + t] * _PLACE[t]
        mixed = mix64(mixed)
        order = np.argsort(mixed, kind="stable")
        small = row[order].astype(np.uint16 if end - start < 65536 else np.int64)
        order = order[np.argsort(small, kind="stable")]
        mixed, row = mixed[order], row[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (mixed[1:] != mixed[:-1]) | (row[1:] != row[:-1])
        mixed, row = mixed[fresh], row[fresh]
        yield start, mixed, np.searchsorted(row, np.arange(end - start + 1))


def super_minhash(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m, uint64: rank in the upper half, draw in the lower).

    In round j each element draws a number and the j-th place of its own random permutation; the
    place keeps the least of (j, number). Ranks only grow, so a row stops early: once every place
    is taken, later rounds cannot change it. Rounds run over all open rows at once.
    """
    rows = len(bounds) - 1
    signature = np.full(rows * m, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds))
    seeds = elements
    permutation = None
    half = np.uint64(32)
    for j in range(m):
        drawn = mix64(seeds + np.uint64((j + 1) * 0xD1B54A32D192ED03 % 2**64))
        place = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> half).astype(np.int64)
        value = (np.uint64(j) << half) | (drawn >> half)
        if j:
            each = np.arange(len(place))
            target = permutation[each, place].astype(np.int64)
            permutation[each, place] = permutation[:, j]
        else:
            target = place
        np.minimum.at(signature, owner * m + target, value)
        open_rows = signature.reshape(rows, m).max(axis=1) > np.uint64(((j + 1) << 32) - 1)
        going = open_rows[owner]
        if not going.any():
            break
        if j == 0:
            seeds, owner, place = seeds[going], owner[going], place[going]
            permutation = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(owner), 1))
            permutation[np.arange(len(owner)), place] = 0
        elif going.mean() < 0.7:
            seeds, owner, permutation = seeds[going], owner[going], permutation[going]
    return signature.reshape(rows, m)
