"""Digests and codecs that Spark lacks, as Arrow UDFs over whole batches; each is registered by name."""

from __future__ import annotations

import gzip
import lzma
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StringType


def over(kind: DataType, f: Callable[[bytes], object]):
    @F.pandas_udf(kind)
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else f(bytes(x)))

    return run


xxh128 = over(StringType(), lambda x: xxhash.xxh3_128_hexdigest(x))
xxh64_low = over(IntegerType(), lambda x: xxhash.xxh64_intdigest(x) & 0xFF)
adler = over(LongType(), lambda x: zlib.adler32(x))


def _crc8_table() -> bytes:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x << 1 ^ 0x07) & 0xFF if x & 0x80 else x << 1
        out.append(x)
    return bytes(out)


_CRC8 = _crc8_table()


def _crc8(data: bytes) -> int:
    """The checksum of headers, a look-up for each byte."""
    crc = 0
    for byte in data:
        crc = _CRC8[crc ^ byte]
    return crc


crc8 = over(IntegerType(), _crc8)


class Router:
    """Codecs by name; `register` adds one.  Data that look compressed already, or would grow, stay as they are."""

    def __init__(self):
        self._codecs: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {}

    def register(self, name: str, pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes]) -> None:
        self._codecs[name.lower()] = (pack, unpack)

    def names(self) -> list[str]:
        return list(self._codecs)

    def compress(self, name: str, data: Column) -> Column:
        return over(BinaryType(), self._codecs[name.lower()][0])(data)

    def decompress(self, name: str, data: Column) -> Column:
        return over(BinaryType(), self._codecs[name.lower()][1])(data)

    def stored(self, name: str, data: Column, compressed: Column) -> Column:
        """What is kept: the smaller of both forms."""
        return F.when(F.octet_length(compressed) < F.octet_length(data), compressed).otherwise(data)


def _zstd(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(data)


def _unzstd(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=int.from_bytes(data[:8], "little"))


def xor_delta(data: bytes) -> bytes:
    """Each byte xor the one before; the first stays."""
    x = np.frombuffer(data, np.uint8)
    return np.concatenate([x[:1], x[1:] ^ x[:-1]]).tobytes()


def undelta(data: bytes) -> bytes:
    return np.bitwise_xor.accumulate(np.frombuffer(data, np.uint8)).tobytes() if data else b""


def rotations_sorted(data: bytes) -> tuple[bytes, int]:
    """Burrows-Wheeler transform by prefix doubling: last column, and the row of the text itself."""
    n = len(data)
    if not n:
        return b"", 0
    rank, step = np.frombuffer(data, np.uint8).astype(np.int64), 1
    while True:
        second = np.roll(rank, -step)
        order = np.lexsort((second, rank))
        fresh = np.concatenate([[0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            break
    order = np.lexsort((np.arange(n), rank))
    x = np.frombuffer(data, np.uint8)
    return x[(order - 1) % n].tobytes(), int(np.flatnonzero(order == 0)[0])


def rotations_undone(last: bytes, row: int) -> bytes:
    x = np.frombuffer(last, np.uint8)
    follow = np.argsort(x, kind="stable")
    out, at = bytearray(), row
    for _ in range(len(x)):
        at = follow[at]
        out.append(x[at])
    return bytes(out)


def to_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for b in data:
        i = table.index(b)
        out.append(i)
        table.insert(0, table.pop(i))
    return bytes(out)


def from_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for i in data:
        b = table.pop(i)
        out.append(b)
        table.insert(0, b)
    return bytes(out)


def default_router() -> Router:
    r = Router()
    r.register("zstd", _zstd, _unzstd)
    r.register("gzip", lambda x: gzip.compress(x, mtime=0), gzip.decompress)
    r.register("deflate", zlib.compress, zlib.decompress)
    r.register("lzma2", lambda x: lzma.compress(x, format=lzma.FORMAT_XZ), lzma.decompress)
    r.register("xz", lambda x: lzma.compress(x, format=lzma.FORMAT_XZ), lzma.decompress)
    return r
