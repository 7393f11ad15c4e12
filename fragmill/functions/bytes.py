"""Byte-level column functions: cuts, digests, names, tests of leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragment limits, block-size table by tier and size bucket, leading bytes of compressed files.
TARGET_FRAGMENTS, MIN_FRAGMENT, MAX_FRAGMENT = 50, 256 * 1024, 64 * 1024 * 1024
SIZE_BUCKETS = (100 * 1024, 1024 * 1024, 10 * 1024 * 1024, 200 * 1024 * 1024, 1024 * 1024 * 1024)
BLOCK_SIZES = {
    "FSS3": (256, 256, 256, 512, 1024, 2048),
    "other": (256, 256, 512, 1024, 2048, 4096),
    "FSS5": (256, 256, 256, 256, 512, 1024),
}
COMPRESSED_HEADS = (
    "FFD8FFE0", "FFD8FFE1", "FFD8FFE2", "FFD8FFE3", "FFD8FFE8",
    "89504E47", "47494638", "504B0304", "504B0506", "504B0708",
    "1F8B08", "52617221", "377ABCAF271C", "494433", "664C6143", "4D546864",
)
FRAMES = {"lz4": "04224D18", "lz4hc": "04224D18", "zstd": "28B52FFD", "gzip": "1F8B", "ckc": "434B43"}


def octets(text: Column) -> Column:
    return text.cast("binary")


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def fragment_size(length: Column, override: int | None = None) -> Column:
    """A fiftieth of the object within limits; an override wins."""
    if override and override > 0:
        return F.lit(override)
    return F.least(F.greatest(F.floor(length / TARGET_FRAGMENTS), F.lit(MIN_FRAGMENT)), F.lit(MAX_FRAGMENT)).cast("long")


def fragment_count(length: Column, size: Column) -> Column:
    return F.ceil(length / size).cast("long")


def block_size(length: Column, strategy: str = "other") -> Column:
    sizes = BLOCK_SIZES.get(strategy, BLOCK_SIZES["other"])
    out = F.lit(sizes[-1])
    for limit, size in reversed(list(zip(SIZE_BUCKETS, sizes))):
        out = F.when(length <= limit, size).otherwise(out)
    return out.cast("int")


def grown_block_size(length: Column, start: Column, most_blocks: int = 60_000, largest: int = 16_384) -> Column:
    """`start`, doubled until there are at most `most_blocks` or it reaches `largest`."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, lambda size, _: F.when((F.ceil(length / size) > most_blocks) & (size < largest), size * 2).otherwise(size))


def cuts(length: Column, size) -> Column:
    """Ordinals of the pieces of an object; none of an empty one."""
    n = F.ceil(length / size).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def piece(data: Column, ordinal: Column, size) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.substr(data, (ordinal * size + 1).cast("int"), size.cast("int"))


def fragment_name(prefix: Column, ordinal: Column) -> Column:
    """`{prefix}_{ordinal}.frag`; null for a name that would leave its folder or a 64-letter prefix that is not hex."""
    unsafe = prefix.rlike(r"[/\\]|\.\.") | ((F.char_length(prefix) == 64) & ~prefix.rlike("^[0-9a-fA-F]{64}$"))
    return F.when(~unsafe, F.format_string("%s_%d.frag", prefix, ordinal))


def remote_path(fingerprint: Column, version: Column, ordinal: Column) -> Column:
    return F.format_string("%s_v%d_%d.frag", fingerprint, version, ordinal)


def safe_path(path: Column) -> Column:
    return ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:|\x00") & (F.length(path) > 0)


def human_size(n: Column, decimal: bool = False) -> Column:
    step, units = (1000, ("B", "KB", "MB", "GB", "TB")) if decimal else (1024, ("B", "KiB", "MiB", "GiB", "TiB"))
    out = F.format_string("%.2f " + units[-1], n / float(step**4))
    for power in (3, 2, 1):
        out = F.when(n < step ** (power + 1), F.format_string("%.2f " + units[power], n / float(step**power))).otherwise(out)
    return F.when(n < step, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def abbreviated(fingerprint: Column) -> Column:
    return F.concat(F.left(fingerprint, F.lit(12)), F.lit("..."), F.right(fingerprint, F.lit(8)))


def looks_compressed(data: Column) -> Column:
    return F.hex(F.substring(data, 1, 8)).rlike("^(" + "|".join(COMPRESSED_HEADS) + ")")


def frame_of(data: Column) -> Column:
    """The codec whose frame the bytes start with; brotli has no mark and is what remains."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith(FRAMES["lz4"]), "lz4")
        .when(head.startswith(FRAMES["zstd"]) | (F.substr(head, F.lit(17), F.lit(8)) == FRAMES["zstd"]), "zstd")
        .when(head.startswith(FRAMES["gzip"]), "gzip")
        .when(head.startswith(FRAMES["ckc"]), "ckc")
        .otherwise("none")
    )


def url_base64(data: Column) -> Column:
    return F.translate(F.rtrim(F.base64(data), F.lit("=")), "+/\r\n", "-_")


def from_url_base64(text: Column) -> Column:
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    return F.unbase64(padded)


def words32(data: Column) -> Column:
    """(position, value) of 4-byte words, big-endian, the last one padded with zeros."""
    count = F.ceil(F.octet_length(data) / 4).cast("int")
    padded = F.rpad(F.hex(data), (count * 8).cast("int"), F.lit("0"))
    return F.transform(F.regexp_extract_all(padded, F.lit("[0-9A-F]{8}"), F.lit(0)), lambda x, i: F.struct(i.alias("word"), F.conv(x, 16, 10).cast("long").alias("value")))


def adler32(data: Column) -> Column:
    """Adler-32 over the bytes, as a fold."""
    values = F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda i: F.conv(F.hex(F.substr(data, i + 1, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    fold = F.aggregate(values, start, lambda acc, v: F.struct(((acc["a"] + v) % 65521).alias("a"), ((acc["b"] + (acc["a"] + v) % 65521) % 65521).alias("b")))
    return F.when(F.octet_length(data) == 0, F.lit(1).cast("long")).otherwise(F.shiftleft(fold["b"], 16) + fold["a"])
