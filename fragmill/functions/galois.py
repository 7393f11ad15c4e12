"""GF(256) over x^8 + x^4 + x^3 + x^2 + 1: tables by rule, products of byte arrays, Reed-Solomon over rows of a matrix."""

from __future__ import annotations

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    return exp, log


EXP, LOG = _tables()
_A = np.arange(256)
MUL = np.where((_A[:, None] == 0) | (_A[None, :] == 0), 0, EXP[(LOG[_A[:, None]] + LOG[_A[None, :]]) % 255]).astype(np.uint8)


def inverse(a: int) -> int:
    return int(EXP[(255 - LOG[a]) % 255])


def coefficient(parity: int, k: int) -> int:
    """alpha^((parity + 1) k)."""
    return int(EXP[(parity + 1) * k % 255])


def encode(data: np.ndarray, parity: int) -> np.ndarray:
    """`parity` rows of check bytes for the rows of `data` (K x width)."""
    out = np.zeros((parity, data.shape[1]), np.uint8)
    for p in range(parity):
        for k in range(len(data)):
            out[p] ^= MUL[coefficient(p, k)][data[k]]
    return out


def inverted(matrix: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan over the field; None for a singular matrix."""
    n = len(matrix)
    m = np.concatenate([matrix.astype(np.uint8), np.eye(n, dtype=np.uint8)], 1)
    for c in range(n):
        at = next((r for r in range(c, n) if m[r, c]), None)
        if at is None:
            return None
        m[[c, at]] = m[[at, c]]
        m[c] = MUL[inverse(int(m[c, c]))][m[c]]
        for r in range(n):
            if r != c and m[r, c]:
                m[r] ^= MUL[int(m[r, c])][m[c]]
    return m[:, n:]


def decode(rows: dict[int, np.ndarray], k: int, width: int) -> np.ndarray | None:
    """All data rows from any K of the rows (data 0..K-1, checks from K on); None if there are too few."""
    have = sorted(rows)[:k]
    if len(have) < k:
        return None
    m = np.zeros((k, k), np.uint8)
    for i, r in enumerate(have):
        if r < k:
            m[i, r] = 1
        else:
            m[i] = [coefficient(r - k, c) for c in range(k)]
    back = inverted(m)
    if back is None:
        return None
    out = np.zeros((k, width), np.uint8)
    for r in range(k):
        for i in range(k):
            if back[r, i]:
                out[r] ^= MUL[int(back[r, i])][rows[have[i]]]
    return out
