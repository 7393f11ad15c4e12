"""Neighbour redundancy: an object's fragments in a ring, each stored with others that can bring it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring_encoded(fragments: DataFrame, data: str = "data", object_id: str = "object_id") -> DataFrame:
    """fragments with `own` and `next`: each with its successor in the ring; a single one is its own successor."""
    w = Window.partitionBy(object_id).orderBy("frag_idx")
    first = F.first(data).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fragments.withColumn("own", F.col(data)).withColumn("next", F.coalesce(F.lead(data).over(w), first))


def ring_sealed(encoded: DataFrame) -> DataFrame:
    """Encoded fragments with the digest of what they hold."""
    return encoded.withColumn("seal", F.sha2(F.concat("own", "next"), 256))


def seal_broken(own: Column, next_: Column, seal: Column) -> Column:
    return F.sha2(F.concat(own, next_), 256) != seal


def ring_recovered(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (object_id, frag_idx, n) with `data` and `source`: what is stored, else the left neighbour's copy of it.

    One round suffices: a fragment is stored twice, with itself and with its left neighbour; where both are gone nothing
    else holds it.
    """
    here = stored.select("object_id", "frag_idx", F.col("own").alias("_own"))
    left = stored.select("object_id", "frag_idx", "next").join(expected.select("object_id", "frag_idx", "n"), ["object_id", "frag_idx"]).select("object_id", F.pmod(F.col("frag_idx") + 1, "n").cast("int").alias("frag_idx"), F.col("next").alias("_left"))
    out = expected.join(here, ["object_id", "frag_idx"], "left").join(left, ["object_id", "frag_idx"], "left")
    return out.select(*expected.columns, F.coalesce("_own", "_left").alias("data"), F.when(F.col("_own").isNotNull(), "stored").when(F.col("_left").isNotNull(), "neighbour").otherwise("lost").alias("source"))


# The two steps by number of fragments.
def steps(n: Column) -> tuple[Column, Column]:
    return (
        F.when(n <= 4, 1).when(n <= 8, 1).when(n <= 16, 2).otherwise(3),
        F.when(n <= 4, 2).when(n <= 8, 3).when(n <= 16, 5).otherwise(7),
    )


def cross_encoded(fragments: DataFrame, data: str = "data") -> DataFrame:
    """fragments (object_id, frag_idx, n, data) with `one` and `two`, the fragments one and two steps on."""
    s1, s2 = steps(F.col("n"))
    at = lambda s, name: fragments.select("object_id", F.pmod(F.col("frag_idx") - s, F.col("n")).cast("int").alias("frag_idx"), F.col(data).alias(name))
    return fragments.join(at(s1, "one"), ["object_id", "frag_idx"]).join(at(s2, "two"), ["object_id", "frag_idx"])


def cross_recovered(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (object_id, frag_idx, n) with `data`: stored, or kept by a fragment one or two steps back."""
    s1, s2 = steps(F.col("n"))
    own = stored.select("object_id", "frag_idx", F.col("data").alias("_own"))
    kept = stored.select("object_id", F.pmod(F.col("frag_idx") + s1, F.col("n")).cast("int").alias("frag_idx"), F.col("one").alias("_kept")).unionByName(stored.select("object_id", F.pmod(F.col("frag_idx") + s2, F.col("n")).cast("int").alias("frag_idx"), F.col("two").alias("_kept")))
    kept = kept.groupBy("object_id", "frag_idx").agg(F.first("_kept").alias("_kept"))
    out = expected.join(own, ["object_id", "frag_idx"], "left").join(kept, ["object_id", "frag_idx"], "left")
    return out.select(*expected.columns, F.coalesce("_own", "_kept").alias("data"), F.when(F.col("_own").isNotNull(), "stored").when(F.col("_kept").isNotNull(), "kept").otherwise("lost").alias("source"))


def replicated(blocks: DataFrame) -> DataFrame:
    """Every fragment carries all blocks of its object: block rows by fragment, each with a short digest."""
    sides = blocks.select("object_id", F.col("block_idx").alias("frag_idx"))
    return sides.join(blocks, "object_id").withColumn("mark", F.left(F.sha2("data", 256), F.lit(16)))
