"""Hashes of word shingles, and the SimHash of such hashes."""

from __future__ import annotations

import numpy as np
import xxhash

HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle in order, repeats included; of the whole sequence if it is shorter; none without words.

    Words are what lies between spaces and the controls 9 to 13; only A-Z are lower-cased.
    """
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    del tokens
    ends = np.cumsum(lengths)
    first, last = (ends - lengths)[: 1 - words or None], (ends - 1)[words - 1 :]
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(first), np.uint64)
    for at in range(0, len(first), HASHES_AT_ONCE):
        stop = at + HASHES_AT_ONCE
        pairs = zip(first[at:stop].tolist(), last[at:stop].tolist(), strict=True)
        out[at:stop] = [digest(joined[a:b], 42) for a, b in pairs]
    return out


def majority_bits(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])
