"""A small CBOR reader and writer for metadata documents: integers, bytes, text, arrays, maps, booleans, null, doubles."""

from __future__ import annotations

import struct

DEEPEST, LARGEST = 64, 100 * 1024 * 1024


class CborError(ValueError):
    pass


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise CborError("integer too large")


def dumps(value) -> bytes:
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode("utf-8")
        return _head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(dumps, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    raise CborError(f"no form for {type(value).__name__}")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CborError("ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, depth: int = 0):
        if depth > DEEPEST:
            raise CborError("too deep")
        first = self.take(1)[0]
        major, low = first >> 5, first & 31
        if major == 7:
            if low in (20, 21, 22, 23):
                return {20: False, 21: True}.get(low)
            size, form = {25: (2, ">e"), 26: (4, ">f"), 27: (8, ">d")}.get(low, (0, ""))
            if not size:
                raise CborError("unknown simple value")
            return struct.unpack(form, self.take(size))[0]
        if low >= 28:
            raise CborError("indefinite lengths are not used")
        n = low if low < 24 else int.from_bytes(self.take(1 << low - 24), "big")
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major == 2:
            return self.take(n)
        if major == 3:
            return self.take(n).decode("utf-8")
        if major == 4:
            return [self.value(depth + 1) for _ in range(n)]
        if major == 5:
            return {self.value(depth + 1): self.value(depth + 1) for _ in range(n)}
        return self.value(depth + 1)  # a tag: its content


def loads(data: bytes):
    if len(data) > LARGEST:
        raise CborError("too large")
    r = _Reader(bytes(data))
    out = r.value()
    if r.at != len(r.data):
        raise CborError("bytes left over")
    return out


# The index document's version and limits.
SCHEMA_VERSION, MOST_FRAGMENTS = 1, 10_000


def index_document(fields: dict) -> bytes:
    """The version first, then what is neither null nor empty."""
    return dumps({"schema_version": SCHEMA_VERSION} | {k: v for k, v in fields.items() if v not in (None, [], {}, "")})


def read_index(data: bytes) -> dict:
    """Known or not, all fields; a document whose first key is no version, or a newer one, is refused."""
    out = loads(data)
    if not isinstance(out, dict) or next(iter(out), None) != "schema_version":
        raise CborError("the version must come first")
    if not isinstance(out["schema_version"], int) or out["schema_version"] > SCHEMA_VERSION:
        raise CborError("a newer version")
    fragments = out.get("fragments", [])
    if len(fragments) > MOST_FRAGMENTS:
        raise CborError("too many fragments")
    for i, f in enumerate(fragments):
        f["index"] = i  # the place in the list counts
    return out
