"""Streams of fragments and status events: deduplication, windowed counts, sessions, held ring neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; `glob` picks them.  Watermarks need `ts` with a time zone."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def status_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of each type in tumbling windows; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def fresh_fragments(fragments: DataFrame, late: str = "1 hour", key: str = "hash") -> DataFrame:
    """The first of each hash within the watermark: deduplication against what came before."""
    return fragments.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ring_pairs(fragments: DataFrame) -> DataFrame:
    """object_id, frag_idx, own, next of a stream (object_id, frag_idx, n, hash): state holds the first and the last piece.

    Pieces of an object come in order; the ring closes with its last one.
    """

    def step(key, batches: Iterator[pd.DataFrame], state):
        first, held, at = state.get if state.exists else (None, None, -1)
        out = []
        for rows in batches:
            for i, n, h in rows.sort_values("frag_idx")[["frag_idx", "n", "hash"]].itertuples(index=False):
                if first is None:
                    first = h
                else:
                    out.append((key[0], at, held, h))
                held, at = h, int(i)
                if at == n - 1:
                    out.append((key[0], at, held, first))
        state.update((first, held, at))
        yield pd.DataFrame(out, columns=["object_id", "frag_idx", "own", "next"])

    return fragments.groupBy("object_id").applyInPandasWithState(step, "object_id long, frag_idx int, own string, next string", "first string, held string, at int", "append", "NoTimeout")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into Parquet files beside its checkpoint; nothing gathers in the driver.

    A batch that is run again overwrites its own files; in complete mode the last batch is the whole result.
    """
    out = f"{checkpoint.rstrip('/')}-{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def saved(stream: DataFrame, path: str, checkpoint: str, every: str = "500 milliseconds"):
    """Starts to keep a stream's newest state of every key in files: changes within `every` are written at once.

    Each batch replaces the files of the one before, so a reader finds the last state; the query is returned.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
