"""A minimal perfect hash over 128-bit keys, built and probed with whole arrays.

Keys are two arrays of 64-bit numbers. At each level a key claims a bit; keys that
claim one alone keep it, the others go on to the next level. A key's index is the
number of set bits before its own, so n keys get exactly 0 to n - 1. An unknown key
gets some index or -1, so users store a fingerprint per index and compare.
"""

from __future__ import annotations

import io

import numpy as np

from gleanery.llm.common import mix64

LEVELS, SPACE = 40, 1.6
COUNTS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(mix64(lo, 2 * level) ^ hi, 2 * level + 1) % np.uint64(size)).astype(np.int64)


def build(hi: np.ndarray, lo: np.ndarray) -> dict[str, np.ndarray]:
    """The hash of distinct keys as named arrays."""
    sizes, bits = [], []
    while len(lo):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-int(len(lo) * SPACE + 64) // 64) * 64
        at = _place(hi, lo, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        again = ~alone[at]
        hi, lo = hi[again], lo[again]
    packed = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
    ones = COUNTS[packed].reshape(-1, 8).sum(axis=1)
    return {"sizes": np.array(sizes, np.int64), "bits": packed, "before": np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)}


def probe(table: dict[str, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The index of each key; -1 for some keys that aren't in the table."""
    out = np.full(len(lo), -1, np.int64)
    rest, start = np.arange(len(lo)), 0
    for level, size in enumerate(table["sizes"].tolist()):
        if not len(rest):
            break
        bit = start + _place(hi[rest], lo[rest], level, size)
        byte = table["bits"][bit >> 3]
        hit = (byte >> (bit & 7).astype(np.uint8)) & 1 == 1
        found = bit[hit]
        word = found >> 6
        in_word = table["bits"][(word[:, None] << 3) + np.arange(8)]
        use = np.clip((found & 63)[:, None] - 8 * np.arange(8), 0, 8)
        mask = ((1 << use) - 1).astype(np.uint8)
        out[rest[hit]] = table["before"][word] + COUNTS[in_word & mask].sum(axis=1)
        rest, start = rest[~hit], start + size
    return out


def to_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}
