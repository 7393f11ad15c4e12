"""Owners of fragment hashes, probes of earlier versions, reference counts and what they leave over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def owners(fragments: DataFrame, hash_key: str = "hash", order: tuple[str, ...] = ("object_id", "frag_idx"), first: bool = True) -> DataFrame:
    """hash_key, the first (or last) owner's `order` columns, ref_count.  Partial aggregation: hot hashes cost nothing."""
    pick = F.min if first else F.max
    return fragments.groupBy(hash_key).agg(pick(F.struct(*order)).alias("_o"), F.count(F.lit(1)).alias("ref_count")).select(hash_key, *(F.col(f"_o.{c}").alias(f"owner_{c}") for c in order), "ref_count")


def first_in_object(fragments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """fragments with `owner`, the least `order` among rows of `keys`; a join on aggregated owners, not a window."""
    first = fragments.groupBy(*keys).agg(F.min(F.struct(*order)).alias("owner"), F.count(F.lit(1)).alias("ref_count"))
    return fragments.join(first, keys)


def probe(new: DataFrame, known: DataFrame, hash_key: str = "hash", veto=None) -> DataFrame:
    """new, left-joined to known owners by hash; `changed` where there is none.  `veto` is an optional residual condition."""
    k = known.withColumnRenamed(hash_key, "_k")
    on = new[hash_key] == k["_k"]
    if veto is not None:
        on = on & ~veto
    return new.join(k, on, "left").withColumn("changed", F.col("_k").isNull()).drop("_k")


def positional(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """new (keys, hash) against old of the same keys, then against any of the old object's hashes: `source`."""
    at = old.select(*keys, F.col("hash").alias("_at"))
    anywhere = old.groupBy(keys[0], "hash").agg(F.min(keys[-1]).alias("_found"))
    out = new.join(at, keys, "left").join(anywhere, [keys[0], "hash"], "left")
    same = F.col("hash").eqNullSafe(F.col("_at"))
    return out.select(*new.columns, F.when(same, F.col(keys[-1])).otherwise(F.col("_found")).alias("source_index"), F.when(same, "same place").when(F.col("_found").isNotNull(), "moved").otherwise("changed").alias("source"))


def collected(dedup_map: DataFrame, references: DataFrame, keep: DataFrame) -> DataFrame:
    """dedup_map with counts less the references that went, without rows at zero that no kept owner holds."""
    gone = references.groupBy("hash").agg(F.count(F.lit(1)).alias("_gone"))
    left = dedup_map.join(gone, "hash", "left").withColumn("ref_count", F.col("ref_count") - F.coalesce("_gone", F.lit(0))).drop("_gone")
    held = keep.select(F.col("owner").alias("_kept")).distinct()
    return left.join(held, left["owner"] == held["_kept"], "left").where((F.col("ref_count") > 0) | F.col("_kept").isNotNull()).drop("_kept")


def orphans(files: DataFrame, *referenced: DataFrame, key: str = "owner") -> DataFrame:
    """files that no relation of `referenced` names."""
    named = referenced[0].select(key)
    for r in referenced[1:]:
        named = named.union(r.select(key))
    return files.join(named.distinct(), key, "left_anti")


def chain(versions: DataFrame, object_id: str = "object_id", version: str = "version") -> DataFrame:
    """versions with the one before, and whether it is the latest."""
    w = Window.partitionBy(object_id).orderBy(version)
    return versions.withColumn("previous", F.lag(version).over(w)).withColumn("is_latest", F.lead(version).over(w).isNull())


def dictionary(samples: DataFrame, least: tuple[int, int] = (2, 3), entries: int = 4096) -> DataFrame:
    """gram (hex), freq, score: the n-grams of `content` that save most, `entries` at most, as a dictionary has room for.

    Those of eight bytes that occur at least `least[0]` times; if there are none, those of four bytes and `least[1]`.
    Counts are partial aggregates; ties go by the gram.
    """

    def counted(n: int, often: int) -> DataFrame:
        x = samples.where(F.octet_length("content") >= n).select(F.hex("content").alias("x"))
        grams = x.select(F.explode(F.transform(F.sequence(F.lit(0), (F.length("x") / 2).cast("int") - n), lambda i: F.substr("x", (2 * i + 1).cast("int"), F.lit(2 * n)))).alias("gram"))
        return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= often).withColumn("score", F.col("freq") * n)

    long = counted(8, least[0])
    chosen = counted(4, least[1]) if long.isEmpty() else long
    return chosen.orderBy(F.desc("score"), "gram").limit(entries)
