"""Word shingles of texts as sets of 64-bit hashes, for whole batches at once.

Words are runs of bytes other than space and control white space, after A-Z are lower-cased. A set holds each run of
n words once; a text with fewer words has its whole sequence as one element; a text without words has an empty set.
Every element's hash depends on all bytes of its words and on their number.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_byte = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_step = np.uint64(0x9E3779B97F4A7C15)
_word_step = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """An even 64-bit hash of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts in order, and the index of its text."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A-Z only
    ends = np.cumsum([len(d) + 1 for d in data])
    raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    at = np.flatnonzero(~_space[raw])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))  # where words begin, in at
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    parts = _byte[raw[at]] * _powers(_step, int(length.max()))[place]
    hashes = mix(np.add.reduceat(parts, first) + length.astype(np.uint64) * _word_step)
    return hashes, np.searchsorted(ends, at[first], side="right")


def shingle_sets(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The elements of each text's set, sorted within it, and the bounds: set i is elements[bounds[i]:bounds[i + 1]]."""
    words, doc = word_hashes(texts)
    per = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    weights = _powers(_word_step, n)
    found, owner = [], []
    if len(words) >= n:
        whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
        sums = sum(words[i : len(words) - n + 1 + i] * weights[i] for i in range(n))
        found.append(mix(sums[whole] + np.uint64(n)))
        owner.append(doc[: len(doc) - n + 1][whole])
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        starts = np.concatenate(([0], np.cumsum(per)))[short]
        found.append(np.array([mix(np.array([(words[s : s + per[d]] * weights[: per[d]]).sum() + np.uint64(per[d])], np.uint64))[0] for s, d in zip(starts, short, strict=True)], np.uint64))
        owner.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    elements, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    elements, owner = elements[order], owner[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    for i in range(len(texts)):
        elements[bounds[i] : bounds[i + 1]].sort()
    new = np.concatenate(([True], (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])))
    elements, owner = elements[new], owner[new]
    return elements, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
