"""Vectorised words and word shingles over blocks of UTF-8 texts (numpy, no row-at-a-time work)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_U = np.uint64
_POWERS = 1 << 14


def _powers() -> np.ndarray:
    out = np.full(_POWERS, 0x9E3779B97F4A7C15 | 1, _U)
    return np.cumprod(out, dtype=_U)


POW = _powers()
#: Words of the near-duplicate contract: everything but ASCII white space; A-Z become a-z.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Words of the containment search: ASCII letters and digits and all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def blocks(texts: list[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `limit` bytes in all (one longer text alone), with the index of the first."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def word_hashes(raw: list[bytes], kind: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to and with each text), in order."""
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    ends_of_text = np.cumsum([len(x) + 1 for x in raw])
    inside = kind[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    upto = np.searchsorted(start, ends_of_text)
    if not len(start):
        return np.zeros(0, _U), upto
    length = end - start
    letters = data[inside].astype(_U) + _U(1)
    first = np.cumsum(length) - length
    at = np.arange(len(letters)) - np.repeat(first, length)
    h = np.add.reduceat(letters * POW[at % _POWERS], first)
    return mix(h + length.astype(_U) * _U(0xD6E8FEB86659FD93)), upto


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of one text's n-word shingles, in order, with repeats; of all its words if there are fewer; none without words."""
    k = len(words)
    if not k:
        return words
    m = min(n, k)
    h = np.zeros(k - m + 1, _U)
    for j in range(m):
        h = h * _U(0x9DDFEA08EB382D69) + mix(words[j : k - m + 1 + j] + _U(j + 1))
    return mix(h + _U(m))


def shingle_sets(texts: list[str], n: int, kind: np.ndarray = PLAIN) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, raw in blocks(texts):
        words, upto = word_hashes(raw, kind)
        a = 0
        for b in upto:
            yield np.unique(shingles(words[a:b], n))
            a = b
