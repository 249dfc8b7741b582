"""Words, word hashes and word shingles of many texts at once, in numpy.

A word is a run of characters that are not white space, in lower case. Hashes are 64 bits wide and the
same in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SHINGLE = 5
#: Words hashed at once, and the bytes from which on a word stands for its digest, so that the arrays of one block stay small.
BLOCK, LONG = 1 << 15, 1 << 10
#: Powers are kept up to this many; texts of longer blocks get theirs for once.
MOST_POWERS = 1 << 20


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for b in (_BASE, _INVERSE):
        steps = np.full(min(2 * n, max(n, MOST_POWERS)), b, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= MOST_POWERS:
        _powers[:] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str], most: int = 1 << 18) -> Iterator[slice]:
    """Slices of texts with about that many characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def spans(split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' UTF-8 bytes in one array, each word's start and end in it, and each text's number of words."""
    counts = np.array([len(w) for w in split], np.int64)
    data = np.frombuffer(" ".join([" ".join(w) for w in split if w]).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    gaps = np.flatnonzero(data == 32)
    return data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)])), counts


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def hash_words(split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and each text's number of words; in blocks, so that memory does not grow with the bytes of a text."""
    counts = np.array([len(w) for w in split], np.int64)
    flat = split[0] if len(split) == 1 else [w for t in split for w in t]
    out = np.zeros(len(flat), np.uint64)
    for at in range(0, len(flat), BLOCK):
        block = flat[at : at + BLOCK]
        if max(map(len, block)) > LONG:
            block = [w if len(w) <= LONG else "\0" + hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for w in block]
        out[at : at + BLOCK] = hash_spans(*spans([block])[:3])
    return out, counts


def slices(batch, rows: int = 256) -> Iterator:
    """Slices of an Arrow batch, so that few texts are Python strings at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words within a text, and each text's number of runs.

    A text of fewer words, but one at least, has one run: all its words.
    """
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    firsts = np.repeat(np.cumsum(counts) - counts, runs) + inside(runs)
    short = np.repeat(counts, runs)
    out = np.zeros(len(firsts), np.uint64)
    for k in range(width):
        at = firsts + k
        word = hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else out
        word = np.where(k < short, word, np.uint64(0))
        out = (out + word) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out), runs


def inside(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. n-1 for each n of lengths, one after the other."""
    return np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
