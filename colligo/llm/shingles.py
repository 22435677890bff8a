"""Word shingles of whole texts as 64-bit hashes, computed in numpy over a batch of UTF-8 buffers.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased.
A set holds the distinct n-word shingles; a text of 1 to n-1 words gives its whole
sequence as one element; a text without words gives the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_R = np.random.default_rng(20240229)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes hashed together; one longer text makes a buffer of its own.
BUFFER = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full(max(n, BUFFER), _BASE, dtype=np.uint64)
            steps[0] = 1
            back = np.full(len(steps), pow(_BASE, -1, 2**64), dtype=np.uint64)
            back[0] = 1
            cls.up, cls.down = np.cumprod(steps), np.cumprod(back)
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and the number of words of each text."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    before = np.r_[True, space[:-1]]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    up, down = _Powers.to(len(buf))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[buf] * up)]
    words = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.r_[0, np.searchsorted(start, ends)])


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    padded = np.r_[words, np.zeros(n, dtype=np.uint64)]
    runs = np.zeros(len(words), dtype=np.uint64)
    for k in range(n):
        runs += padded[k : k + len(words)] * _PLACE[k]
    runs = mix(runs)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(runs[at : at + c - n + 1]))
        elif c:
            out.append(mix((words[at : at + c] * _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += c
    return out


def in_buffers(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """shingle_sets over any number of texts, a bounded buffer at a time."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        held.append(b)
        size += len(b)
        if size >= BUFFER:
            yield from shingle_sets(held, n)
            held, size = [], 0
    if held:
        yield from shingle_sets(held, n)
