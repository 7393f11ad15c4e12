"""Block maps kept by three nodes, and what they say of each block when held against each other.

Node A is the index, B the fragments' trailers, C the recovery container.  A trailer keeps 2-byte and 8-byte digests
of the other two; A and C keep 8-byte digests of each other and of the fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B

SHORT, LONG = 4, 16  # hex letters of 2-byte and 8-byte digests


def block_map(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h32, h8, h2 of each block."""
    h = blocks.select(*keys, B.digest(F.col("data")).alias("h32"))
    return h.select(*keys, "h32", F.left("h32", F.lit(LONG)).alias("h8"), F.left("h32", F.lit(SHORT)).alias("h2"))


def map_difference(a: DataFrame, b: DataFrame, keys: list[str], column: str = "h32") -> DataFrame:
    """keys of blocks on which two maps differ; a block that one of them lacks differs."""
    left, right = a.select(*keys, F.col(column).alias("_a")), b.select(*keys, F.col(column).alias("_b"))
    return left.join(right, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").otherwise("differs").alias("difference"))


def fragment_verdict(now2: Column, now8: Column, kept2: Column, in_a: Column, in_c: Column) -> Column:
    """ok where the short digest holds; else suspicious if either 8-byte map still has the block, corrupted if neither."""
    return F.when(now2.eqNullSafe(kept2), "ok").when(F.coalesce(now8 == in_a, F.lit(False)) | F.coalesce(now8 == in_c, F.lit(False)), "suspicious").otherwise("corrupted")


def node_verdict(now2: Column, now8: Column, consensus2: Column, trailer8: Column, peer8: Column) -> Column:
    """ok by the trailers' short digest, passed by an 8-byte one of a trailer or of the peer, else corrupted."""
    return F.when(now2.eqNullSafe(consensus2), "ok").when(F.coalesce(now8 == trailer8, F.lit(False)) | F.coalesce(now8 == peer8, F.lit(False)), "passed").otherwise("corrupted")


def consensus(trailers: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, `value` where all trailers agree, else the first one's, and whether they agree."""
    return trailers.groupBy(*keys).agg(F.min_by(value, order).alias(value), (F.countDistinct(value) == 1).alias("agreed"))


def valid(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """An object is valid if nothing is corrupted; suspicious blocks do not count."""
    return verdicts.groupBy(*keys).agg(F.bool_and(F.col("verdict") != "corrupted").alias("is_valid"), F.count_if(F.col("verdict") == "corrupted").alias("corrupted"), F.count_if(F.col("verdict") == "suspicious").alias("suspicious"), F.count(F.lit(1)).alias("blocks"))
