"""Queries over codecs, encryption, containers and streams; round trips, whose outcome SQL states."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import aes, codecs
from ..functions import bytes as B
from ..sources import cbor, container
from ..streaming import status
from .catalog import register
from .chunk_queries import OBJECTS, objects

_KEY, _NONCE = bytes(range(32)), bytes(12)


def _round_trip(name: str):
    def query(spark, sf_dir):
        r = codecs.default_router()
        o = objects(spark, sf_dir).withColumn("packed", r.compress(name, F.col("content")))
        o = o.withColumn("back", r.decompress(name, F.col("packed")))
        kept = r.stored(name, F.col("content"), F.col("packed"))
        return o.select("object_id", F.octet_length("content").alias("size"), (F.octet_length(kept) <= F.octet_length("content")).alias("fits"), (F.col("back") == F.col("content")).alias("same"))

    query.__doc__ = f"Documents through {name} and back; the smaller form is stored."
    return query


for _name in ("zstd", "gzip", "xz"):
    register(f"{_name}_roundtrip", f"WITH {OBJECTS} SELECT object_id, n::INTEGER AS size, true AS fits, true AS same FROM objects")(_round_trip(_name))


@register("aes_ctr_roundtrip")
def aes_ctr_roundtrip(spark, sf_dir):
    """Documents encrypted in counter mode by column expressions, and back."""
    o = objects(spark, sf_dir).withColumn("sealed", aes.sealed(F.col("content"), F.lit(_NONCE), _KEY))
    return o.select("object_id", B.digest(F.col("sealed")).alias("sealed_hash"), (aes.opened(F.col("sealed"), _KEY) == F.col("content")).alias("same"))


_DELTA = "xor(('0x' || hex(content[i : i]))::INTEGER, CASE WHEN i = 1 THEN 0 ELSE ('0x' || hex(content[i - 1 : i - 1]))::INTEGER END)"


@register(
    "delta_roundtrip",
    f"WITH {OBJECTS} SELECT object_id, sha256(unhex(array_to_string(list_transform(range(1, n + 1), lambda i : substr('0123456789ABCDEF', ({_DELTA} // 16)::INTEGER + 1, 1) || substr('0123456789ABCDEF', {_DELTA} % 16 + 1, 1)), ''))) AS packed_hash, true AS same FROM objects",
)
def delta_roundtrip(spark, sf_dir):
    pack, unpack = codecs.over(BinaryType(), codecs.xor_delta), codecs.over(BinaryType(), codecs.undelta)
    o = objects(spark, sf_dir).withColumn("packed", pack("content"))
    return o.select("object_id", B.digest(F.col("packed")).alias("packed_hash"), (unpack("packed") == F.col("content")).alias("same"))


@register(
    "container_roundtrip",
    f"WITH {OBJECTS} SELECT object_id, true AS is_fragment, (1 + object_id % 2)::INTEGER AS header_version, object_id::VARCHAR AS original_name, n::BIGINT AS file_size, true AS same FROM objects",
)
def container_roundtrip(spark, sf_dir):
    """Documents as fragment files in memory, parsed as columns: header, slim index, payload."""
    @F.pandas_udf("binary")
    def made(i: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([container.fragment_file({"original_name": str(a), "file_size": len(b)}, bytes(b), _NONCE, bytes(32) if a % 2 else b"") for a, b in zip(i, c)])

    f = objects(spark, sf_dir).withColumn("file", made("object_id", "content"))
    p = container.index_and_payload(container.parsed(f, "file"), "body")
    d = container.decoded_indexes(p)
    return d.select("object_id", "is_fragment", "header_version", "original_name", "file_size", (F.col("payload") == F.col("content")).alias("same"))


@register(
    "index_source",
    "SELECT lpad(r_regionkey::VARCHAR, 64, '0') AS object_id, r_name AS original_name, (r_regionkey * 100)::BIGINT AS file_size, r_regionkey::INTEGER AS fragment_count, 'FSS1' AS fss_strategy, 'zstd' AS compression FROM region",
)
def index_source(spark, sf_dir):
    """Index documents of the regions' backups, read through the data source."""
    container.register(spark)
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()  # five regions
    docs = [cbor.index_document({"original_hash": f"{r['r_regionkey']:064x}", "original_name": r["r_name"], "file_size": r["r_regionkey"] * 100, "fragments": [{"size": 1}] * r["r_regionkey"], "fss_strategy": "FSS1", "compression": "zstd"}).hex() for r in rows]
    return spark.read.format("fragmill-index").option("documents", ",".join(docs)).option("numPartitions", "2").load()




def _checkpoint(spark) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{conf.rstrip('/')}/stream-{os.urandom(8).hex()}" if conf else tempfile.mkdtemp(prefix="fragmill-stream-")


@register("status_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def status_windows(spark, sf_dir):
    """The windowed counts as a batch; the same function serves the stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return status.status_counts(e).withColumn("total", F.round("total", 4))


@register(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, s""",
)
def event_sessions(spark, sf_dir):
    return status.sessions(spark.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", "start", "end", "n")


@register("stream_status_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_status_counts(spark, sf_dir):
    """Windowed counts from a stream over the events file, all of it in one run."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    counts = status.status_counts(status.event_stream(spark, sf_dir, schema))
    return status.drained(counts, f"counts_{os.urandom(4).hex()}", _checkpoint(spark), "complete").withColumn("total", F.round("total", 4)).orderBy("start", "event_type")


@register("stream_dedup", "SELECT DISTINCT sha256(user_id || '|' || event_type) AS hash FROM events")
def stream_dedup(spark, sf_dir):
    """Distinct event types and users of a stream, the first of each within the watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = status.event_stream(spark, sf_dir, schema).select("ts", F.sha2(F.concat_ws("|", "user_id", "event_type"), 256).alias("hash"))
    return status.drained(status.fresh_fragments(e, "3650 days"), f"fresh_{os.urandom(4).hex()}", _checkpoint(spark)).select("hash")
