"""Vectorised word and n-gram hashing over whole batches of texts (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
#: Texts are joined into blobs of about this many bytes, longer ones are cut between words: memory stays bounded.
BLOB = 1 << 20

#: A-Z lower-cased, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, a-z and every byte of a non-ASCII character (after lower-casing).
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        m, i = np.full(size, _MULT, np.uint64), np.full(size, _INV, np.uint64)
        m[0] = i[0] = 1
        with np.errstate(over="ignore"):
            _pow, _inv = np.multiply.accumulate(m), np.multiply.accumulate(i)
    return _pow, _inv


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (data[k] + 1) * m^k over i <= k < j, modulo 2^64."""
    p, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Position-independent hashes of the byte windows [start, end)."""
    _, i = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[ends] - prefix[starts]) * i[: len(prefix)][starts]


def pieces(text: str | None) -> list[bytes]:
    """UTF-8 of a text in pieces of about BLOB bytes, cut only where no word is cut, if it has such a place."""
    b = (text or "").encode("utf-8", "replace")
    out, at = [], 0
    while len(b) - at > BLOB:
        end = at + BLOB
        while end < len(b) and IS_WORD[LOWER[b[end]]]:
            end += 1
        out.append(b[at:end])
        at = end
    return [*out, b[at:]]


def blobs(texts):
    """(bytes, index of the first text, starts of the texts' parts in the blob, owner of each part), blob by blob."""
    parts, owners, size = [], [], 0
    for k, t in enumerate(texts):
        for p in pieces(t):
            if parts and size + len(p) > BLOB:
                yield parts, owners
                parts, owners, size = [], [], 0
            parts.append(p)
            owners.append(k)
            size += len(p) + 1
    if parts:
        yield parts, owners


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and bounds: text k has hashes[bounds[k]:bounds[k + 1]].

    A word is a run of digits, a-z (A-Z lower-cased) and non-ASCII characters. Null and empty texts have none.
    """
    texts = list(texts)
    counts, found = np.zeros(len(texts) + 1, np.int64), []
    for parts, owners in blobs(texts):
        low = LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        word = IS_WORD[low]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[0::2], edges[1::2]
        found.append(mix(window_hashes(prefix_hashes(low), starts, ends)))
        begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        owner = np.asarray(owners)[np.searchsorted(begins, starts, "right") - 1]
        counts[1:] += np.bincount(owner, minlength=len(texts))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(counts)
