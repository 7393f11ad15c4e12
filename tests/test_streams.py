"""Streams give what batches give; the ring closes across micro-batches."""

from pyspark.sql import functions as F

from fragmill.streaming import status


def test_windows_equal_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = status.event_stream(spark, sf_dir, batch.schema)
    got = status.drained(status.status_counts(s), "windows", str(tmp_path / "c"), "complete")
    want = status.status_counts(batch)
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(want)


def test_dedup(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = status.event_stream(spark, sf_dir, batch.schema).select("ts", F.col("event_type").alias("hash"))
    got = status.drained(status.fresh_fragments(s, "9999 days"), "fresh", str(tmp_path / "c"))
    assert got.count() == batch.select("event_type").distinct().count()


def test_ring_pairs(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, i, 3, f"h{i}")], "object_id long, frag_idx int, n int, hash string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    s = spark.readStream.schema("object_id long, frag_idx int, n int, hash string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = status.drained(status.ring_pairs(s), "ring", str(tmp_path / "c"))
    assert sorted((r["frag_idx"], r["own"], r["next"]) for r in got.collect()) == [(0, "h0", "h1"), (1, "h1", "h2"), (2, "h2", "h0")]
