"""Words and shingles of a text, as the near-duplicate operators read them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

# Word pattern, hash seed, bits of a fingerprint.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case."""
    return WORD.findall(text.encode().translate(_LOWER))


def hashes(own: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle, none has none."""
    size = min(words, len(own))
    if not size:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    parts = zip(*(own[i:] for i in range(size)), strict=False)
    return np.array([digest(b" ".join(p), SEED) for p in parts], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes, repeats included; zero where there are none."""
    set_bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<u8")[0])
