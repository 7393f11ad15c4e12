"""AES-256 counter mode for workers, where the JVM's cipher is out of reach: whole arrays of blocks at once in numpy.

Tables follow from the field's rules; nothing is stored.  Columns use `aes.aes_ctr`, which stays in the JVM.
"""

from __future__ import annotations

import numpy as np


def _double(x: int) -> int:
    return (x << 1 ^ 0x1B) & 0xFF if x & 0x80 else x << 1


def _substitution() -> np.ndarray:
    power, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)  # times three
    out = []
    for b in range(256):
        inv = power[(255 - log[b]) % 255] if b else 0
        y = inv
        for turn in range(1, 5):
            y ^= (inv << turn | inv >> 8 - turn) & 0xFF
        out.append(y ^ 0x63)
    return np.array(out, np.uint8)


_S = _substitution()
_TWICE = np.array([_double(i) for i in range(256)], np.uint8)
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])


def round_keys(key: bytes) -> np.ndarray:
    words = [list(key[i : i + 4]) for i in range(0, 32, 4)]
    carry = 1
    for i in range(8, 60):
        w = list(words[-1])
        if i % 8 == 0:
            w = [int(_S[x]) for x in w[1:] + w[:1]]
            w[0] ^= carry
            carry = _double(carry)
        elif i % 8 == 4:
            w = [int(_S[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[-8], w)])
    return np.array(words, np.uint8).reshape(15, 16)


def encrypted(blocks: np.ndarray, key: bytes) -> np.ndarray:
    """blocks (n x 16) under a key of 32 bytes."""
    keys = round_keys(key)
    x = blocks ^ keys[0]
    for r in range(1, 15):
        x = _S[x][:, _SHIFT]
        if r < 14:
            c = x.reshape(-1, 4, 4)
            n = np.roll(c, -1, 2)
            x = (_TWICE[c] ^ _TWICE[n] ^ n ^ np.roll(c, -2, 2) ^ np.roll(c, -3, 2)).reshape(-1, 16)
        x = x ^ keys[r]
    return x


def crypt(data: bytes, nonce: bytes, key: bytes, first: int = 1) -> bytes:
    """Encrypts or decrypts with the counters nonce || first, first + 1, ..."""
    n = -(-len(data) // 16)
    blocks = np.zeros((n, 16), np.uint8)
    blocks[:, :12] = np.frombuffer(nonce, np.uint8)
    blocks[:, 12:] = np.arange(first, first + n, dtype=">u4").view(np.uint8).reshape(-1, 4)
    return (np.frombuffer(data, np.uint8) ^ encrypted(blocks, key).reshape(-1)[: len(data)]).tobytes()
