"""Hashes of words and of runs of words, made for a whole text at once."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
#: Powers kept for texts up to so many bytes; for longer ones they are made anew.
KEPT = 1 << 20


def _ladder(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = _ladder(_INVERSE, max(n, 64))
    return _INVERSES


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = _ladder(_BASE, max(n, 64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (the finaliser of the published splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_in(raw: np.ndarray, space: np.ndarray = SPACE, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (64 bits), first byte and size of each word (run of bytes that are no space) of a text's UTF-8 bytes; with
    tail, the bytes of that kind at a word's end are a word of their own, and the last array tells which these are."""
    inside = ~space[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), at, at, np.zeros(0, bool)
    body = raw[at]
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each word, among at
    is_tail = np.zeros(len(first), bool)
    if tail is not None:
        size = np.diff(first, append=len(at))
        last = np.maximum.reduceat(np.where(tail[body], -1, np.arange(len(at))), first)
        cut = np.flatnonzero((last >= 0) & (last + 1 < first + size))
        is_tail = np.insert(is_tail, cut + 1, True)
        first = np.insert(first, cut + 1, last[cut] + 1)
    size = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, size)
    return mix(np.add.reduceat((body.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[place], first)), at[first], size, is_tail


def pieces_in(raw: np.ndarray, space: np.ndarray, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words_in with the same hashes, from running sums over the whole text: fewer passes over its bytes."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(space[raw], out=inside[1:-1])
    border = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = border[::2], border[1::2]
    is_tail = np.zeros(len(start), bool)
    if tail is not None and len(start):
        signs = np.zeros(len(raw) + 1, bool)
        signs[1:] = tail[raw]
        runs = np.flatnonzero(signs[1:] & ~signs[:-1])  # where signs begin
        last = np.flatnonzero(signs[stop])  # words that end in one
        cut = runs[np.searchsorted(runs, stop[last], "left") - 1] if len(last) else last
        last, cut = last[cut > start[last]], cut[cut > start[last]]
        is_tail, start, stop = np.insert(is_tail, last + 1, True), np.insert(start, last + 1, cut), np.insert(stop, last, cut)
    n = len(raw)
    power, inverse = (_powers(n), _inverses(n)) if n <= KEPT else (_ladder(_BASE, n), _ladder(_INVERSE, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[stop] - sums[start]) * inverse[start]), start, stop - start, is_tail


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, in order; words end at ASCII white space."""
    return words_in(raw)[0]


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + n]
    return mix(out)


def lower_ascii(text: str) -> np.ndarray:
    """UTF-8 bytes of a text with A-Z in lower case."""
    return np.frombuffer(text.encode().lower(), np.uint8)
