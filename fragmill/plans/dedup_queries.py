"""Queries over version chains, deduplication, reference counts and restores.

A conversation is an object, each of its turns a version with its own content; documents of one source are versions of
one catalogue.  All joins are on hashes or keys; owners are aggregated before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import chunking, dedup
from .catalog import register
from .chunk_queries import OBJECTS, blocks_sql, objects

_V = "v AS (SELECT conv_id AS object_id, turn AS version, encode(text) AS content, octet_length(encode(text)) AS n FROM conversations)"
_F = "f AS (SELECT object_id, version, i::INTEGER AS frag_idx, sha256(content[i * 64 + 1 : i * 64 + 64]) AS hash FROM (SELECT *, unnest(range(0, (n + 63) // 64)) AS i FROM v))"


def versions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("object_id"), F.col("turn").alias("version"), B.octets(F.col("text")).alias("content"))


def version_fragments(spark, sf_dir):
    f = chunking.split(versions(spark, sf_dir), 64, keep=("object_id", "version"))
    return f.select("object_id", "version", "frag_idx", "size", B.digest(F.col("data")).alias("hash"))


@register(
    "version_dedup",
    f"""WITH {_V}, {_F}, o AS (SELECT hash, min((object_id, version, frag_idx)) AS o, count(*) AS refs FROM f GROUP BY hash)
    SELECT f.object_id, f.version, count(*)::BIGINT AS fragments, count_if(o.o = (f.object_id, f.version, f.frag_idx))::BIGINT AS stored,
           count_if(o.o[1] <> f.object_id)::BIGINT AS from_other_objects, sum(o.refs)::BIGINT AS refs
    FROM f JOIN o USING (hash) GROUP BY f.object_id, f.version""",
)
def version_dedup(spark, sf_dir):
    f = dedup.first_in_object(version_fragments(spark, sf_dir), ["hash"], ["object_id", "version", "frag_idx"])
    mine = F.col("owner") == F.struct("object_id", "version", "frag_idx")
    return f.groupBy("object_id", "version").agg(F.count(F.lit(1)).alias("fragments"), F.count_if(mine).alias("stored"), F.count_if(F.col("owner.object_id") != F.col("object_id")).alias("from_other_objects"), F.sum("ref_count").alias("refs"))


@register(
    "incremental_probe",
    f"""WITH {OBJECTS}, {blocks_sql(256, 'b', 'frag_idx')}, h AS (SELECT object_id, frag_idx, sha256(data) AS hash FROM b),
    k AS (SELECT hash, min((object_id, frag_idx)) AS o, count(*) AS refs FROM h WHERE object_id % 2 = 0 GROUP BY hash)
    SELECT h.object_id, h.frag_idx::INTEGER AS frag_idx, k.o[1]::BIGINT AS source_object, k.o[2]::INTEGER AS source_index, k.hash IS NULL AS changed, coalesce(k.refs, 0)::BIGINT AS refs
    FROM h LEFT JOIN k USING (hash) WHERE h.object_id % 2 = 1""",
)
def incremental_probe(spark, sf_dir):
    """Odd objects arrive after even ones: each fragment is found among what is known, or changed."""
    h = chunking.split(objects(spark, sf_dir), 256).select("object_id", "frag_idx", B.digest(F.col("data")).alias("hash"))
    known = dedup.owners(h.where("object_id % 2 = 0"))
    out = dedup.probe(h.where("object_id % 2 = 1"), known)
    return out.select("object_id", "frag_idx", F.col("owner_object_id").alias("source_object"), F.col("owner_frag_idx").alias("source_index"), "changed", F.coalesce("ref_count", F.lit(0)).alias("refs"))


@register(
    "probe_with_checksum_veto",
    f"""WITH {OBJECTS}, {blocks_sql(256, 'b', 'frag_idx')}, h AS (SELECT object_id, frag_idx, sha256(data) AS hash, octet_length(data) AS size FROM b),
    k AS (SELECT hash, min((object_id, frag_idx)) AS o FROM h WHERE object_id % 2 = 0 GROUP BY hash)
    SELECT count(*)::BIGINT AS probed, count_if(k.hash IS NOT NULL AND NOT k.o[2] > h.frag_idx)::BIGINT AS hits, count_if(k.hash IS NOT NULL AND k.o[2] > h.frag_idx)::BIGINT AS vetoed
    FROM h LEFT JOIN k USING (hash) WHERE h.object_id % 2 = 1""",
)
def probe_with_checksum_veto(spark, sf_dir):
    """The residual predicate of a probe: here a hit counts only if the owner does not lie further back."""
    h = chunking.split(objects(spark, sf_dir), 256).select("object_id", "frag_idx", B.digest(F.col("data")).alias("hash"))
    known = dedup.owners(h.where("object_id % 2 = 0"))
    new = h.where("object_id % 2 = 1")
    vetoed = dedup.probe(new, known, veto=known["owner_frag_idx"] > new["frag_idx"])
    plain = dedup.probe(new, known)
    a = vetoed.agg(F.count(F.lit(1)).alias("probed"), F.count_if(~F.col("changed")).alias("hits"))
    b = plain.agg(F.count_if(~F.col("changed")).alias("all_hits"))
    return a.join(F.broadcast(b)).select("probed", "hits", (F.col("all_hits") - F.col("hits")).alias("vetoed"))


@register(
    "positional_compare",
    f"""WITH {_V}, {_F}, n AS (SELECT object_id, version, frag_idx, hash FROM f WHERE version >= 1),
    o AS (SELECT object_id, version + 1 AS version, frag_idx, hash FROM f),
    w AS (SELECT object_id, version, hash, min(frag_idx) AS found FROM o GROUP BY ALL)
    SELECT n.object_id, n.version, n.frag_idx, CASE WHEN o.hash = n.hash THEN n.frag_idx ELSE w.found END AS source_index,
           CASE WHEN o.hash = n.hash THEN 'same place' WHEN w.found IS NOT NULL THEN 'moved' ELSE 'changed' END AS source
    FROM n LEFT JOIN o USING (object_id, version, frag_idx) LEFT JOIN w ON w.object_id = n.object_id AND w.version = n.version AND w.hash = n.hash""",
)
def positional_compare(spark, sf_dir):
    """Each version against the one before: by place first, then by content anywhere in it."""
    f = version_fragments(spark, sf_dir).select("object_id", "version", "frag_idx", "hash")
    old = f.withColumn("version", F.col("version") + 1)
    at = old.withColumnRenamed("hash", "_at")
    anywhere = old.groupBy("object_id", "version", "hash").agg(F.min("frag_idx").alias("_found"))
    out = f.where("version >= 1").join(at, ["object_id", "version", "frag_idx"], "left").join(anywhere, ["object_id", "version", "hash"], "left")
    same = F.col("hash").eqNullSafe(F.col("_at"))
    return out.select("object_id", "version", "frag_idx", F.when(same, F.col("frag_idx")).otherwise(F.col("_found")).alias("source_index"), F.when(same, "same place").when(F.col("_found").isNotNull(), "moved").otherwise("changed").alias("source"))


@register(
    "refcount_gc",
    f"""WITH {OBJECTS}, {blocks_sql(256, 'b', 'frag_idx')}, h AS (SELECT object_id, sha256(data) AS hash FROM b),
    m AS (SELECT hash, min(object_id) AS owner, count(*) AS refs FROM h GROUP BY hash),
    g AS (SELECT hash, count(*) AS gone FROM h WHERE object_id % 3 = 0 GROUP BY hash)
    SELECT m.hash, m.owner, (m.refs - coalesce(g.gone, 0))::BIGINT AS ref_count FROM m LEFT JOIN g USING (hash)
    WHERE m.refs - coalesce(g.gone, 0) > 0 OR m.owner % 3 = 1""",
)
def refcount_gc(spark, sf_dir):
    h = chunking.split(objects(spark, sf_dir), 256).select("object_id", B.digest(F.col("data")).alias("hash"))
    m = h.groupBy("hash").agg(F.min("object_id").alias("owner"), F.count(F.lit(1)).alias("ref_count"))
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 1").select(F.col("doc_id").alias("owner"))
    return dedup.collected(m, h.where("object_id % 3 = 0"), kept).select("hash", "owner", "ref_count")


@register(
    "version_history",
    """SELECT conv_id AS object_id, turn AS version, role AS user_message, octet_length(encode(text))::BIGINT AS file_size, sha256(encode(text)) AS fingerprint,
    lag(turn) OVER w AS previous, lead(turn) OVER w IS NULL AS is_latest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def version_history(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("object_id"), F.col("turn").alias("version"), F.col("role").alias("user_message"), F.octet_length(B.octets(F.col("text"))).cast("long").alias("file_size"), B.digest(B.octets(F.col("text"))).alias("fingerprint"))
    return dedup.chain(v)


@register("latest_version", "SELECT conv_id AS object_id, max(turn) AS version, arg_max(role, turn) AS user_message, count(*)::BIGINT AS versions FROM conversations GROUP BY conv_id")
def latest_version(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return v.groupBy(F.col("conv_id").alias("object_id")).agg(F.max("turn").alias("version"), F.max_by("role", "turn").alias("user_message"), F.count(F.lit(1)).alias("versions"))


@register(
    "restore_version",
    """WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE turn <= 2 GROUP BY conv_id)
    SELECT c.conv_id AS object_id, c.turn AS version, sha256(encode(c.text)) AS restored_hash, octet_length(encode(c.text))::BIGINT AS file_size FROM conversations c JOIN l USING (conv_id, turn)
    WHERE octet_length(encode(c.text)) > 0""",
)
def restore_version(spark, sf_dir):
    """The latest version up to the third, fetched fragment by fragment from whoever owns each hash."""
    f = chunking.split(versions(spark, sf_dir), 64, keep=("object_id", "version")).withColumn("hash", B.digest(F.col("data")))
    store = f.groupBy("hash").agg(F.min(F.hex("data")).alias("stored"))
    wanted = f.where("version <= 2").groupBy("object_id").agg(F.max("version").alias("version"))
    got = f.drop("data").join(wanted, ["object_id", "version"]).join(store, "hash").withColumn("data", F.unhex("stored"))
    back = chunking.merged(got, ["object_id", "version"])
    return back.select("object_id", "version", B.digest(F.col("content")).alias("restored_hash"), F.octet_length("content").cast("long").alias("file_size"))


@register(
    "unchanged_versions",
    """WITH h AS (SELECT conv_id AS object_id, turn AS version, sha256(encode(text)) AS fp FROM conversations)
    SELECT object_id, version, fp AS fingerprint, fp IS NOT DISTINCT FROM lag(fp) OVER (PARTITION BY object_id ORDER BY version) AS unchanged FROM h""",
)
def unchanged_versions(spark, sf_dir):
    """A version equal to the one before adds a record and no fragments."""
    w = Window.partitionBy("object_id").orderBy("version")
    v = versions(spark, sf_dir).select("object_id", "version", B.digest(F.col("content")).alias("fingerprint"))
    return v.withColumn("unchanged", F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w)))


@register(
    "orphan_indexes",
    f"""WITH {_V}, {_F}, o AS (SELECT hash, min((object_id, version)) AS o FROM f GROUP BY hash),
    used AS (SELECT DISTINCT o[1] AS object_id, o[2] AS version FROM o),
    cur AS (SELECT conv_id AS object_id, max(turn) AS version FROM conversations GROUP BY conv_id)
    SELECT conv_id AS object_id, turn AS version FROM conversations c
    WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.object_id = c.conv_id AND u.version = c.turn) AND NOT EXISTS (SELECT 1 FROM cur u WHERE u.object_id = c.conv_id AND u.version >= c.turn AND u.version - 1 <= c.turn)""",
)
def orphan_indexes(spark, sf_dir):
    """Versions that own no fragment and are neither current nor the one before."""
    f = version_fragments(spark, sf_dir)
    used = f.groupBy("hash").agg(F.min(F.struct("object_id", "version")).alias("o")).select("o.object_id", "o.version")
    v = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("object_id"), F.col("turn").alias("version"))
    latest = v.groupBy("object_id").agg(F.max("version").alias("version"))
    kept = latest.union(latest.select("object_id", F.col("version") - 1))
    return v.join(used.union(kept).distinct(), ["object_id", "version"], "left_anti")


@register(
    "cross_object_dedup",
    f"""WITH {OBJECTS}, {blocks_sql(64, 'b', 'i')}, d AS (SELECT DISTINCT sha256(data) AS hash FROM b),
    p AS (SELECT item_id, sha256(encode(text)[j * 64 + 1 : j * 64 + 64]) AS hash FROM (SELECT *, unnest(range(0, (octet_length(encode(text)) + 63) // 64)) AS j FROM benchmark))
    SELECT p.item_id, count(*)::BIGINT AS blocks, count(d.hash)::BIGINT AS shared FROM p LEFT JOIN d USING (hash) GROUP BY p.item_id""",
)
def cross_object_dedup(spark, sf_dir):
    d = chunking.split(objects(spark, sf_dir), 64).select(B.digest(F.col("data")).alias("hash")).distinct().withColumn("found", F.lit(1))
    p = chunking.split(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", B.octets(F.col("text")).alias("content")), 64, keep=("item_id",)).select("item_id", B.digest(F.col("data")).alias("hash"))
    return p.join(d, "hash", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("blocks"), F.count("found").alias("shared"))


@register(
    "dictionary_of_versions",
    """SELECT role, count(DISTINCT conv_id)::BIGINT AS objects, count(*)::BIGINT AS versions, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY role""",
)
def dictionary_of_versions(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("role").agg(F.countDistinct("conv_id").alias("objects"), F.count(F.lit(1)).alias("versions"), F.sum(F.octet_length(B.octets(F.col("text")))).alias("bytes"))
