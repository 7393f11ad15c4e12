"""Queries over version chains, catalogue changes and purges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import chunking, versions
from ..sources import readers
from .catalog import register
from .dedup_queries import version_fragments
from .dedup_queries import versions as all_versions

_V = "v AS (SELECT conv_id AS object_id, turn AS version, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS number, encode(text) AS content, octet_length(encode(text)) AS n FROM conversations)"
_F = "f AS (SELECT object_id, number, i::INTEGER AS frag_idx, sha256(content[i * 64 + 1 : i * 64 + 64]) AS hash FROM (SELECT *, unnest(range(0, (n + 63) // 64)) AS i FROM v))"


def numbered_fragments(spark, sf_dir):
    f = chunking.split(versions.numbered(all_versions(spark, sf_dir)), 64, keep=("object_id", "version", "number"))
    return f.select("object_id", F.col("number").cast("long").alias("number"), "frag_idx", B.digest(F.col("data")).alias("hash"), B.adler32(F.col("data")).alias("checksum"))


@register(
    "version_chain",
    f"""WITH {_V}, {_F}, j AS (SELECT f.*, p.hash IS NOT NULL AND p.hash <> f.hash AS veto FROM f LEFT JOIN f p ON p.object_id = f.object_id AND p.number = f.number - 1 AND p.frag_idx = f.frag_idx),
    s AS (SELECT j.*, number = 1 OR veto OR NOT EXISTS (SELECT 1 FROM f e WHERE e.object_id = j.object_id AND e.hash = j.hash AND e.number >= 2 AND e.number < j.number) AS stored FROM j),
    o AS (SELECT a.object_id, a.number, a.frag_idx, max((b.number, b.frag_idx)) AS owner FROM s a JOIN s b ON a.object_id = b.object_id AND a.hash = b.hash AND b.stored AND b.number >= 2 AND b.number < a.number WHERE NOT a.stored GROUP BY ALL)
    SELECT s.object_id, s.number, s.frag_idx, s.stored, owner[1]::BIGINT AS source_number, owner[2]::INTEGER AS source_index FROM s LEFT JOIN o USING (object_id, number, frag_idx)""",
)
def version_chain(spark, sf_dir):
    return versions.chained(numbered_fragments(spark, sf_dir)).select("object_id", "number", "frag_idx", "stored", "source_number", "source_index")


@register(
    "version_chain_whole",
    f"""WITH {_V}, {_F}, o AS (SELECT object_id, hash, min((number, frag_idx)) AS owner FROM f WHERE number >= 2 GROUP BY ALL)
    SELECT f.object_id, f.number, f.frag_idx, f.number = 1 OR owner = (f.number, f.frag_idx) AS stored,
           CASE WHEN f.number >= 2 AND owner <> (f.number, f.frag_idx) THEN owner[1] END::BIGINT AS source_number,
           CASE WHEN f.number >= 2 AND owner <> (f.number, f.frag_idx) THEN owner[2] END::INTEGER AS source_index
    FROM f LEFT JOIN o USING (object_id, hash)""",
)
def version_chain_whole(spark, sf_dir):
    return versions.chained_whole(numbered_fragments(spark, sf_dir)).select("object_id", "number", "frag_idx", F.coalesce("stored", F.lit(True)).alias("stored"), "source_number", "source_index")


@register(
    "version_map_size",
    f"""WITH {_V}, {_F}, k AS (SELECT object_id, hash, min(number) AS first FROM f WHERE number >= 2 GROUP BY ALL), v2 AS (SELECT DISTINCT object_id, number FROM v)
    SELECT v2.object_id, v2.number, count(k.hash)::BIGINT AS known FROM v2 LEFT JOIN k ON k.object_id = v2.object_id AND k.first <= v2.number GROUP BY ALL""",
)
def version_map_size(spark, sf_dir):
    """Hashes that the map handed on by each version holds; none for the first."""
    from pyspark.sql import Window

    f = numbered_fragments(spark, sf_dir)
    firsts = f.where("number >= 2").groupBy("object_id", "hash").agg(F.min("number").alias("number")).groupBy("object_id", "number").agg(F.count(F.lit(1)).alias("added"))
    every = versions.numbered(all_versions(spark, sf_dir)).select("object_id", F.col("number").cast("long").alias("number")).distinct()
    w = Window.partitionBy("object_id").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.join(firsts, ["object_id", "number"], "left").select("object_id", "number", F.coalesce(F.sum("added").over(w), F.lit(0)).alias("known"))


@register(
    "inherited_salt",
    "SELECT conv_id AS object_id, turn AS version, sha256(first_value(conv_id::VARCHAR || ':' || turn::VARCHAR) OVER (PARTITION BY conv_id ORDER BY turn)) AS salt, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS records FROM conversations",
)
def inherited_salt(spark, sf_dir):
    """Every version keeps the salt of the object's first one, and the history of all versions up to it."""
    from pyspark.sql import Window

    w = Window.partitionBy("object_id").orderBy("version")
    v = all_versions(spark, sf_dir).select("object_id", "version")
    own = F.concat_ws(":", F.col("object_id").cast("string"), F.col("version").cast("string"))
    return v.select("object_id", "version", F.sha2(F.first(own).over(w), 256).alias("salt"), F.row_number().over(w).cast("long").alias("records"))


_LOC = "SELECT l_orderkey AS object_id, l_linenumber AS frag_idx, l_suppkey AS backend, (round(l_quantity * 1024))::BIGINT AS file_size, l_shipdate AS uploaded_at, l_linestatus AS state FROM lineitem"


def _locations(spark, sf_dir):
    li = readers.placed(spark, f"{sf_dir}/lineitem.parquet")
    return li.select("place", F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("frag_idx"), F.col("l_suppkey").alias("backend"), F.round(F.col("l_quantity") * 1024).cast("long").alias("file_size"), F.col("l_shipdate").alias("uploaded_at"), F.col("l_linestatus").alias("state"))


@register(
    "catalog_upserts",
    f"""WITH l AS ({_LOC}), u AS (SELECT *, 0 AS new FROM l WHERE state = 'F' UNION ALL SELECT object_id, frag_idx, backend, file_size + 1, uploaded_at, state, 1 FROM l WHERE frag_idx % 2 = 0)
    SELECT object_id, frag_idx, arg_max(backend, (uploaded_at, new)) AS backend, arg_max(file_size, (uploaded_at, new)) AS file_size, max(uploaded_at) AS uploaded_at FROM u GROUP BY ALL""",
)
def catalog_upserts(spark, sf_dir):
    """Fragment locations: half of all line items arrive anew and replace what the catalogue has under their key.

    Some keys have two line items of one date; the SQL takes the first in the table.
    """
    l = _locations(spark, sf_dir)  # noqa: E741
    new = l.where("frag_idx % 2 = 0").withColumn("file_size", F.col("file_size") + 1)
    return versions.upserted(l.where("state = 'F'").drop("state"), new.drop("state"), ["object_id", "frag_idx"], "uploaded_at", "place")


@register(
    "ensured_projects",
    "WITH p AS (SELECT o_custkey AS object_id, min(o_orderkey) AS created FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), r AS (SELECT o_custkey AS object_id, min(o_orderkey) + 1000000 AS created FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) SELECT * FROM p UNION ALL SELECT * FROM r WHERE object_id NOT IN (SELECT object_id FROM p)",
)
def ensured_projects(spark, sf_dir):
    """Customers with closed orders are known; those with open ones are entered unless they are."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("created"), "o_orderstatus")
    known = o.where("o_orderstatus = 'F'").groupBy("object_id").agg(F.min("created").alias("created"))
    return versions.ensured(known, o.where("o_orderstatus <> 'F'").select("object_id", (F.col("created") + 1000000).alias("created")), ["object_id"], "created")


@register(
    "purge_version",
    f"""WITH {_V}, {_F}, p AS (SELECT *, number = 2 OR object_id % 5 = 0 AS purged FROM f), h AS (SELECT hash, bool_and(purged) AS gone FROM p GROUP BY hash)
    SELECT object_id, count_if(NOT purged)::BIGINT AS kept, count_if(purged)::BIGINT AS removed, count_if(purged AND gone)::BIGINT AS files_removed FROM p JOIN h USING (hash) GROUP BY object_id""",
)
def purge_version(spark, sf_dir):
    """The second version of every object goes, and all versions of every fifth; files go that no version keeps."""
    f = numbered_fragments(spark, sf_dir).withColumnRenamed("number", "version")
    going = f.where("version = 2 OR object_id % 5 = 0").select("object_id", "version").distinct()
    kept, files = versions.purged(f, going)
    rows = kept.select("object_id", "hash", F.lit(1).alias("kept"), F.lit(0).alias("removed")).unionByName(f.join(going, ["object_id", "version"], "left_semi").select("object_id", "hash", F.lit(0).alias("kept"), F.lit(1).alias("removed")))
    marked = rows.join(files.withColumn("gone", F.lit(1)), "hash", "left")
    return marked.groupBy("object_id").agg(F.sum("kept").alias("kept"), F.sum("removed").alias("removed"), F.sum(F.col("removed") * F.coalesce("gone", F.lit(0))).alias("files_removed"))
