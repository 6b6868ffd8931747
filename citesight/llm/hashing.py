"""Vectorised polynomial hashes of many slices of one buffer, and batches of bounded size.

With ``S[i]`` the sum of ``code[j] * BASE**j`` for ``j < i`` (mod 2**64), the
hash of a slice is ``(S[end] - S[start]) * BASE**-start``: one running sum
serves every slice, and equal slices hash alike wherever they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
MIX_A = np.uint64(0xD6E8FEB86659FD93)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x * MIX_A
    x ^= x >> np.uint64(32)
    x *= MIX_B
    return x ^ (x >> np.uint64(29))


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``codes[s:e]`` for each pair; ``codes`` are well-spread 64-bit values."""
    POWERS.grow(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * POWERS.up[:len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * POWERS.down[starts]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer of all texts, a zero after each, and where each begins (and the buffer ends)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\0".join([*texts, b""]), np.uint8), at


def bounded(batches, column: str = "text", limit: int = 1 << 19):
    """Cut record batches into slices of at most about ``limit`` bytes of ``column``.

    A task works on one slice at a time, so its memory follows the slice (or one longer text), not the
    batch. Every batch gives at least one slice.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        share = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
