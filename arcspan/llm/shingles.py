"""Word and shingle hashes of whole batches of texts, vectorised in numpy.

Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. A word's
hash is a polynomial over its bytes, taken from running sums over the batch; a shingle's hash
mixes those of its words. Hashes have 64 bits: among 10**9 different shingles or sets the chance
that any two collide is under 3 %.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at once; memory is about 40 times as much.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of `data`, and where they start."""
    raw = np.frombuffer(data, np.uint8)
    apart = _SEPARATOR[raw]
    edge = np.flatnonzero(np.diff(apart, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(text: bytes) -> list[bytes]:
    """A long text, cut between words."""
    out, at = [], 0
    while len(text) - at > 2 * CHUNK:
        found = _SPACE.search(text, at + CHUNK)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's place, their number, all their words' hashes, and each
    word's text (counted from the run's first)."""
    at = 0
    while at < len(texts):
        first, size, chunk = at, 0, []
        while at < len(texts) and (not chunk or size < CHUNK):
            chunk.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(chunk[-1]) + 1
            at += 1
        if size > 2 * CHUNK:
            parts = [(_hash_words(p)[0], k) for k, x in enumerate(chunk) for p in _pieces(x)]
            yield first, len(chunk), np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), k) for p, k in parts])
        else:
            words, start = _hash_words(b"\n".join(chunk))
            begin = np.cumsum([0, *(len(x) + 1 for x in chunk[:-1])])
            yield first, len(chunk), words, np.searchsorted(begin, start, "right") - 1


def shingle_sets(texts: list[str | None], size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's place, how many distinct shingles each has, and those
    shingles' hashes, ascending within a text, text after text. A text with fewer words than
    `size` has its whole sequence as one shingle, one without words none."""
    factors = mix(np.arange(7, 7 + size, dtype=np.uint64)) | np.uint64(1)
    for first, count, words, owner in word_hashes(texts):
        per = np.bincount(owner, minlength=count)
        whole = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            whole += words[k : k + len(whole)] * factors[k]
        inside = owner[: len(whole)] == owner[size - 1 :] if len(whole) else np.zeros(0, bool)
        hashes, owners = [mix(whole[inside])], [owner[: len(whole)][inside]]
        few = np.flatnonzero((per > 0) & (per < size))
        if len(few):
            begin = np.cumsum(per) - per
            short = np.full(len(few), np.uint64(0xD6E8FEB86659FD93), np.uint64) * per[few].astype(np.uint64)
            for k in range(size - 1):
                has = per[few] > k
                short[has] += words[begin[few[has]] + k] * factors[k]
            hashes.append(mix(mix(short)))
            owners.append(few)
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[keep], o[keep]
        yield first, np.bincount(o, minlength=count), h
