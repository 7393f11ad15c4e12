"""Queries over block maps of three nodes, with deterministic damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import chunking, validation
from .catalog import register
from .chunk_queries import OBJECTS, blocks_sql, objects

_BAD = "(object_id * 31 + block_idx * 7) % 97"
_CROSS = f"""{OBJECTS}, {blocks_sql(256)}, t AS (SELECT object_id, block_idx, sha256(data) AS k,
    sha256(CASE WHEN {_BAD} IN (13, 14) THEN data || 'X'::BLOB ELSE data END) AS now, {_BAD} AS r FROM blocks),
    m AS (SELECT object_id, block_idx, left(now, 4) AS now2, left(now, 16) AS now8,
          CASE WHEN r = 15 THEN 'ffff' ELSE left(k, 4) END AS kept2,
          CASE WHEN r = 14 THEN left(now, 16) WHEN r = 16 THEN NULL ELSE left(k, 16) END AS in_a, CASE WHEN r = 17 THEN NULL ELSE left(k, 16) END AS in_c FROM t),
    v AS (SELECT object_id, block_idx, CASE WHEN now2 = kept2 THEN 'ok' WHEN coalesce(now8 = in_a, false) OR coalesce(now8 = in_c, false) THEN 'suspicious' ELSE 'corrupted' END AS verdict FROM m)"""


def blocks(spark, sf_dir):
    return chunking.split(objects(spark, sf_dir), 256, ordinal="block_idx").select("object_id", "block_idx", "data")


def residue():
    return (F.col("object_id") * 31 + F.col("block_idx") * 7) % 97


def crossed(spark, sf_dir):
    """Blocks as they are now against the trailer's short digest and the maps in A and C.

    Damage by residue: 13 and 14 change the data, 14 also in A's map; 15 breaks the trailer; A lacks 16, C lacks 17.
    """
    b, r = blocks(spark, sf_dir), residue()
    kept = validation.block_map(b, ["object_id", "block_idx"])
    now = validation.block_map(b.withColumn("data", F.when(r.isin(13, 14), F.concat("data", F.lit(b"X"))).otherwise(F.col("data"))), ["object_id", "block_idx"])
    keys = ["object_id", "block_idx"]
    trailer = kept.select(*keys, F.when(r == 15, "ffff").otherwise(F.col("h2")).alias("kept2"))
    a = kept.join(now.select(*keys, F.col("h8").alias("n8")), keys).where(r != 16).select(*keys, F.when(r == 14, F.col("n8")).otherwise(F.col("h8")).alias("in_a"))
    c = kept.where(r != 17).select(*keys, F.col("h8").alias("in_c"))
    rows = now.select(*keys, F.col("h2").alias("now2"), F.col("h8").alias("now8")).join(trailer, keys, "full").join(a, keys, "full").join(c, keys, "full")
    return rows.withColumn("verdict", validation.fragment_verdict(F.col("now2"), F.col("now8"), F.col("kept2"), F.col("in_a"), F.col("in_c")))


@register("block_map", f"WITH {OBJECTS}, {blocks_sql(256)} SELECT object_id, block_idx::INTEGER AS block_idx, sha256(data) AS h32, left(sha256(data), 16) AS h8, left(sha256(data), 4) AS h2 FROM blocks")
def block_map(spark, sf_dir):
    return validation.block_map(blocks(spark, sf_dir), ["object_id", "block_idx"])


@register("crossval_fragments", f"WITH {_CROSS} SELECT object_id, block_idx::INTEGER AS block_idx, verdict FROM v")
def crossval_fragments(spark, sf_dir):
    return crossed(spark, sf_dir).select("object_id", "block_idx", "verdict")


@register("crossval_objects", f"WITH {_CROSS} SELECT object_id, bool_and(verdict <> 'corrupted') AS is_valid, count_if(verdict = 'corrupted')::BIGINT AS corrupted, count_if(verdict = 'suspicious')::BIGINT AS suspicious, count(*)::BIGINT AS blocks FROM v GROUP BY object_id")
def crossval_objects(spark, sf_dir):
    return validation.valid(crossed(spark, sf_dir), ["object_id"])


@register(
    "crossval_index",
    """WITH i AS (SELECT page_id, sha256(url) AS h, sha256(CASE WHEN page_id % 7 = 3 THEN url || '_CORRUPTED' ELSE url END) AS now FROM pages),
    t AS (SELECT page_id, j AS trailer, CASE WHEN (page_id + j) % 5 = 0 AND page_id % 2 = 0 THEN 'ffff' ELSE left(h, 4) END AS h2 FROM i, (SELECT unnest([0, 1, 2]) AS j)),
    c AS (SELECT page_id, arg_min(h2, trailer) AS h2, count(DISTINCT h2) = 1 AS agreed FROM t GROUP BY page_id)
    SELECT i.page_id, c.agreed, CASE WHEN left(i.now, 4) = c.h2 THEN 'ok' WHEN left(i.now, 16) = left(i.h, 16) THEN 'passed' ELSE 'corrupted' END AS verdict FROM i JOIN c USING (page_id)""",
)
def crossval_index(spark, sf_dir):
    """An index record against what three trailers keep of it, and the peer's 8-byte digest."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", B.digest(F.col("url").cast("binary")).alias("h"), B.digest(F.when(F.col("page_id") % 7 == 3, F.concat("url", F.lit("_CORRUPTED"))).otherwise(F.col("url")).cast("binary")).alias("now"))
    t = p.select("page_id", "h", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("trailer"))
    broken = ((F.col("page_id") + F.col("trailer")) % 5 == 0) & (F.col("page_id") % 2 == 0)
    t = t.select("page_id", "trailer", F.when(broken, "ffff").otherwise(F.left("h", F.lit(4))).alias("h2"))
    c = validation.consensus(t, ["page_id"], "h2", "trailer")
    eight = F.left("h", F.lit(16))
    return p.join(c, "page_id").select("page_id", "agreed", validation.node_verdict(F.left("now", F.lit(4)), F.left("now", F.lit(16)), F.col("h2"), eight, eight).alias("verdict"))


@register(
    "block_map_difference",
    f"""WITH {OBJECTS}, {blocks_sql(256)}, a AS (SELECT object_id, block_idx, sha256(data) AS h FROM blocks WHERE {_BAD} <> 20),
    b AS (SELECT object_id, block_idx, sha256(CASE WHEN {_BAD} = 13 THEN data || 'X'::BLOB ELSE data END) AS h FROM blocks WHERE {_BAD} <> 21)
    SELECT object_id, block_idx::INTEGER AS block_idx, CASE WHEN a.h IS NULL THEN 'only right' WHEN b.h IS NULL THEN 'only left' ELSE 'differs' END AS difference
    FROM a FULL JOIN b USING (object_id, block_idx) WHERE a.h IS DISTINCT FROM b.h""",
)
def block_map_difference(spark, sf_dir):
    b, r, keys = blocks(spark, sf_dir), residue(), ["object_id", "block_idx"]
    left = validation.block_map(b.where(r != 20), keys)
    right = validation.block_map(b.where(r != 21).withColumn("data", F.when(r == 13, F.concat("data", F.lit(b"X"))).otherwise(F.col("data"))), keys)
    return validation.map_difference(left, right, keys)
