"""Objects into fragments and blocks, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B


def split(objects: DataFrame, size, content: str = "content", ordinal: str = "frag_idx", keep: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """keep, ordinal, size, data: pieces of `size` bytes (a number or a Column), the last one short; none of nothing."""
    size = F.lit(size) if isinstance(size, int) else size
    rows = objects.select(*keep, F.col(content).alias("_content"), size.cast("int").alias("_size"))
    rows = rows.select(*keep, "_content", "_size", F.explode(B.cuts(F.octet_length("_content"), F.col("_size"))).alias(ordinal))
    data = B.piece(F.col("_content"), F.col(ordinal), F.col("_size"))
    return rows.select(*keep, ordinal, F.octet_length(data).alias("size"), data.alias("data"))


def padded(data: Column, size: int) -> Column:
    """A block filled up with zeros to `size` bytes."""
    return F.unhex(F.rpad(F.hex(data), size * 2, "0"))


def merged(fragments: DataFrame, keys: list[str], ordinal: str = "frag_idx", data: str = "data", trim: str | None = None) -> DataFrame:
    """keys, content: pieces in order, trimmed to the least value of `trim` where given.  One object fits a row."""
    parts = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("i"), F.hex(data).alias("d")))).alias("parts"), *([F.min(trim).alias("_trim")] if trim else []))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["d"]), ""))
    return parts.select(*keys, (F.substr(whole, F.lit(1), F.col("_trim").cast("int")) if trim else whole).alias("content"))


def documents_as_objects(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("object_id"), B.octets(F.col("text")).alias("content"))
