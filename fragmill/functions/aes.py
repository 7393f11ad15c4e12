"""AES-256 in counter mode as a column expression, and the key functions around it.

Spark has no counter mode; a key stream of ECB blocks over the counters, xor the data, is the same thing and stays in
the JVM.  A counter is a nonce of 12 bytes and a big-endian 32-bit number that starts at one.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

NONCE, FIRST, ROUNDS = 12, 1, 600_000


def derived_key(password: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode("utf-8"), salt, rounds, 32)


def legacy_key(password: str) -> bytes:
    return hashlib.sha256(password.encode("utf-8")).digest()


def fresh_nonce() -> bytes:
    return os.urandom(NONCE)


def key_stream(nonce: Column, key: bytes, blocks: Column) -> Column:
    """Hex of the stream: the encrypted counters, without the padding block that Spark's ECB adds."""
    counters = F.transform(F.sequence(F.lit(FIRST), blocks), lambda i: F.concat(F.hex(nonce), F.lpad(F.hex(i), 8, "0")))
    whole = F.unhex(F.array_join(counters, ""))
    return F.left(F.hex(F.aes_encrypt(whole, F.lit(key), F.lit("ECB"), F.lit("PKCS"))), (blocks * 32).cast("int"))


def xor_hex(a: Column, b: Column) -> Column:
    """xor of two hex strings of one length, seven bytes at a time."""
    parts = lambda x: F.regexp_extract_all(x, F.lit("[0-9A-F]{1,14}"), F.lit(0))
    number = lambda x: F.conv(x, 16, 10).cast("long")
    return F.array_join(F.transform(F.arrays_zip(parts(a).alias("a"), parts(b).alias("b")), lambda x: F.lpad(F.hex(number(x["a"]).bitwiseXOR(number(x["b"]))), F.length(x["a"]), F.lit("0"))), "")


def aes_ctr(data: Column, nonce: Column, key: bytes) -> Column:
    """Encrypts or decrypts; empty data stays empty."""
    n = F.octet_length(data)
    stream = F.left(key_stream(nonce, key, F.ceil(n / 16).cast("int")), (n * 2).cast("int"))
    return F.when(n > 0, F.unhex(xor_hex(F.hex(data), stream))).otherwise(data)


def sealed(data: Column, nonce: Column, key: bytes) -> Column:
    """Nonce, then the encrypted bytes."""
    return F.concat(nonce, aes_ctr(data, nonce, key))


def opened(data: Column, key: bytes) -> Column:
    return aes_ctr(F.substr(data, F.lit(NONCE + 1), F.octet_length(data)), F.substring(data, 1, NONCE), key)
