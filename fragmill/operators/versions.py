"""Version chains: the map of known hashes that each version hands on, catalogue upserts, purges.

The first version of an object is stored whole and hands on no map.  From the second on, a fragment whose hash the map
knows is a reference, any other is stored and enters the map.  Owners come from windows over one hash of one object, or
from aggregates, so a hash that many versions share costs one row a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(versions: DataFrame, object_id: str = "object_id", version: str = "version") -> DataFrame:
    """versions with `number`, from 1."""
    return versions.withColumn("number", F.dense_rank().over(Window.partitionBy(object_id).orderBy(version)))


def chained(fragments: DataFrame) -> DataFrame:
    """fragments (object_id, number, frag_idx, hash, checksum) with stored, source_number and source_index.

    One fragment, one encoded fragment: a fragment is stored if the map lacks its hash, or if the fragment in its place
    one version before has another checksum.  It refers to the latest stored one of the versions before, the last of
    equal ones.
    """
    before = fragments.select("object_id", (F.col("number") + 1).alias("number"), "frag_idx", F.col("checksum").alias("_was"))
    known = Window.partitionBy("object_id", "hash").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    rows = fragments.join(before, ["object_id", "number", "frag_idx"], "left").withColumn("_veto", F.coalesce(F.col("_was") != F.col("checksum"), F.lit(False)))
    # a hash that a version from the second on held before is in the map, stored there or referred to
    held = F.coalesce(F.max(F.col("number") >= 2).over(known), F.lit(False))
    rows = rows.withColumn("stored", (F.col("number") == 1) | ~held | F.col("_veto"))
    owner = F.max(F.when(F.col("stored") & (F.col("number") >= 2), F.struct("number", "frag_idx"))).over(known)
    rows = rows.withColumn("_owner", F.when(~F.col("stored"), owner))
    return rows.select(*fragments.columns, "stored", F.col("_owner.number").alias("source_number"), F.col("_owner.frag_idx").alias("source_index"))


def chained_whole(fragments: DataFrame) -> DataFrame:
    """The same where a version is encoded as a whole and duplicates are deleted afterwards: the first of equal ones owns."""
    owners = fragments.where("number >= 2").groupBy("object_id", "hash").agg(F.min(F.struct("number", "frag_idx")).alias("_owner"))
    rows = fragments.join(owners, ["object_id", "hash"], "left")
    mine = F.col("_owner") == F.struct("number", "frag_idx")
    reused = (F.col("number") >= 2) & ~mine
    return rows.select(*fragments.columns, (~reused).alias("stored"), F.when(reused, F.col("_owner.number")).alias("source_number"), F.when(reused, F.col("_owner.frag_idx")).alias("source_index"))


def upserted(existing: DataFrame, records: DataFrame, keys: list[str], order: str, place: str | None = None) -> DataFrame:
    """A catalogue after `records`: one row for each key, the one with the greatest `order`, new ones before old ones.

    Of rows equal in both the one with the smallest `place` (a number, not in the result) stays; without it they must
    not differ.  A null field leaves what the next row has there; a null `order` comes last and thus replaces others.
    Rows that repeat a key meet in partial aggregation, so a key that a third of all records name costs a row a task.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(records.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys and c != place]
    rank = F.struct(F.col(order).isNull().alias("_open"), order, "_new", *([(-F.col(place)).alias("_place")] if place else []))
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest))


def ensured(existing: DataFrame, records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows, and of records with an unknown key the first one each: what is there is never replaced."""
    new = records.join(existing.select(*keys), keys, "left_anti")
    rest = [c for c in existing.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")
    return existing.unionByName(first.select(*existing.columns))


def purged(locations: DataFrame, versions: DataFrame, keys: tuple[str, ...] = ("object_id", "version")) -> tuple[DataFrame, DataFrame]:
    """What stays of `locations` without `versions`, and the files (hash) that only those held and that go with them."""
    kept = locations.join(versions.select(*keys).distinct(), list(keys), "left_anti")
    gone = locations.join(versions.select(*keys).distinct(), list(keys), "left_semi").select("hash").distinct()
    return kept, gone.join(kept.select("hash").distinct(), "hash", "left_anti")
