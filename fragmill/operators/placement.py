"""Where fragments live: placement, push, pull, transfer plans, locations, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(backends: DataFrame, forced: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """backends (name, ...) in use, with their ordinal and number: the forced ones if any, else all but the excluded."""
    b = backends
    if forced:
        b = b.where(F.lower("name").isin([x.lower() for x in forced]))
    elif excluded:
        b = b.where(~F.lower("name").isin([x.lower() for x in excluded]))
    from pyspark.sql import Window

    w = Window.orderBy("name")  # backends are a handful
    return b.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("number", F.count(F.lit(1)).over(Window.partitionBy()))


def placed(fragments: DataFrame, backends: DataFrame, ordinal: str = "frag_idx") -> DataFrame:
    """fragments with `backend`: round robin by ordinal, the recovery container (a negative ordinal) on the first."""
    names = backends.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("_names"))
    at = F.when(F.col(ordinal) < 0, F.lit(0)).otherwise(F.pmod(F.col(ordinal), F.size("_names")))
    return fragments.crossJoin(F.broadcast(names)).withColumn("backend", F.element_at("_names", (at + 1).cast("int"))).drop("_names")  # one row of names


def to_push(local: DataFrame, located: DataFrame, keys: list[str]) -> DataFrame:
    """What no location holds yet."""
    return local.join(located.select(*keys).distinct(), keys, "left_anti")


def to_pull(located: DataFrame, local: DataFrame, keys: list[str], catalog_hash: str, local_hash: str) -> DataFrame:
    """What is absent locally or differs from the catalogue."""
    return located.join(local, keys, "left").where(~F.col(catalog_hash).eqNullSafe(F.col(local_hash)))


def semi_or_all(wanted: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Rows of `wanted` whose key is registered, in either case; all of them if none is."""
    known = registered.select(F.lower(key).alias("_k")).distinct()
    hit = wanted.join(known, F.lower(wanted[key]) == known["_k"], "left").withColumn("_hit", F.col("_k").isNotNull())
    some = hit.agg(F.max("_hit").alias("_some"))
    return hit.crossJoin(F.broadcast(some)).where(F.col("_hit") | ~F.coalesce("_some", F.lit(False))).drop("_k", "_hit", "_some")


def latest(df: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("_x")).select(*keys, "_x.*")


def status(expected: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """expected (keys, hash) with status ok, corrupted or missing; without an expected hash what is there is accepted."""
    there = available.select(*keys, F.col("hash").alias("_got"), F.lit(True).alias("_there"))
    state: Column = F.when(F.col("_there").isNull(), "missing").when(F.col("hash").isNull() | (F.col("hash") == F.col("_got")), "ok").otherwise("corrupted")
    return expected.join(there, keys, "left").withColumn("status", state).drop("_got", "_there")


def pushed(local: DataFrame, located: DataFrame, backends: DataFrame, keys: tuple[str, ...] = ("object_id", "frag_idx")) -> DataFrame:
    """keys, backend, pushed: the catalogue after a push.  What is located stays; the rest is placed and recorded."""
    new = placed(to_push(local, located, list(keys)), backends)
    columns = [*keys, "backend"]
    return located.select(*columns, F.lit(False).alias("pushed")).unionByName(new.select(*columns, F.lit(True).alias("pushed")))


def pull_list(located: DataFrame, local: DataFrame, keys: list[str], version: str) -> DataFrame:
    """version, files, to_pull, bytes (n of located), versions ascending: what a pull would do."""
    seen = located.join(local, keys, "left").withColumn("_pull", ~F.col("catalog_hash").eqNullSafe(F.col("local_hash")))
    return seen.groupBy(version).agg(F.count(F.lit(1)).alias("files"), F.count_if("_pull").alias("to_pull"), F.sum("n").alias("bytes")).orderBy(version)


def with_factories(remotes: DataFrame, factories: DataFrame) -> DataFrame:
    """remotes (kind, ...) with the factory of their kind, in either case; null if none is registered."""
    f = factories.select(F.lower("kind").alias("_kind"), "factory")
    return remotes.join(f, F.lower(remotes["kind"]) == F.col("_kind"), "left").drop("_kind")


def canonical(indexes: DataFrame, key: str = "object_id", validation: str = "fss6") -> DataFrame:
    """key, hash: digests of index rows without their validation fields, whose names start with `validation`."""
    fields = [F.col(f"`{c}`").cast("string") for c in indexes.columns if not c.startswith(validation)]
    return indexes.select(key, F.sha2(F.concat_ws("|", *fields), 256).alias("hash"))


def batches(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """rows with `batch`: the number of the run of equal flags that a row belongs to, from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    starts = (~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int")
    return rows.withColumn("_s", starts).withColumn("batch", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")
