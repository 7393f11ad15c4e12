"""Queries over the catalogue: suppliers are backends, orders object versions, line items their fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import chunking, placement
from .catalog import register
from .chunk_queries import OBJECTS, blocks_sql, objects


def backends(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def locations(spark, sf_dir):
    """object_id, version, frag_idx, backend, file_size, uploaded_at: a line item is a stored fragment."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("frag_idx"), F.col("l_suppkey").alias("backend"), F.round(F.col("l_quantity") * 1024).cast("long").alias("file_size"), F.col("l_linestatus").alias("state"), F.col("l_shipdate").alias("uploaded_at"))


_B = "b AS (SELECT n_name AS name, n_regionkey AS region, row_number() OVER (ORDER BY n_name) - 1 AS ordinal, count(*) OVER () AS number FROM nation {where})"


@register(
    "round_robin_placement",
    f"WITH {_B.format(where='')} SELECT l_orderkey AS object_id, l_linenumber AS frag_idx, l_partkey AS part, l_suppkey AS supplier, b.name AS backend FROM lineitem JOIN b ON l_linenumber % b.number = b.ordinal",
)
def round_robin_placement(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("frag_idx"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return placement.placed(f, placement.candidates(backends(spark, sf_dir)))


@register(
    "placement_excluding",
    f"WITH {_B.format(where=chr(87) + 'HERE lower(n_name) NOT IN (SELECT lower(n_name) FROM nation WHERE n_regionkey = 1)')}, p AS (SELECT l_linenumber % b.number AS k, b.name, l_quantity FROM lineitem JOIN b ON l_linenumber % b.number = b.ordinal) SELECT name AS backend, count(*)::BIGINT AS fragments FROM p GROUP BY name",
)
def placement_excluding(spark, sf_dir):
    all_ = backends(spark, sf_dir)
    names = [r["name"] for r in all_.where("region = 1").collect()]  # nations of one region
    f = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("frag_idx"))
    return placement.placed(f, placement.candidates(all_, excluded=names)).groupBy("backend").agg(F.count(F.lit(1)).alias("fragments"))


@register(
    "push_missing",
    "SELECT o_orderkey AS object_id, o_orderstatus AS state, o_orderpriority AS priority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')",
)
def push_missing(spark, sf_dir):
    local = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))
    return placement.to_push(local, locations(spark, sf_dir).where("state = 'F'"), ["object_id"])


@register(
    "pull_changed",
    """WITH c AS (SELECT doc_id, sha256(encode(text)) AS catalog_hash FROM documents), l AS (SELECT doc_id, sha256(encode(text || CASE WHEN doc_id % 7 = 0 THEN 'X' ELSE '' END)) AS local_hash FROM documents WHERE doc_id % 5 <> 0)
    SELECT c.doc_id AS object_id, c.catalog_hash, l.local_hash FROM c LEFT JOIN l USING (doc_id) WHERE c.catalog_hash IS DISTINCT FROM l.local_hash""",
)
def pull_changed(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("object_id"), "text")
    catalog = d.select("object_id", B.digest(B.octets(F.col("text"))).alias("catalog_hash"))
    local = d.where("object_id % 5 <> 0").select("object_id", B.digest(B.octets(F.concat("text", F.when(F.col("object_id") % 7 == 0, "X").otherwise("")))).alias("local_hash"))
    return placement.to_pull(catalog, local, ["object_id"], "catalog_hash", "local_hash").select("object_id", "catalog_hash", "local_hash")


@register(
    "version_fragment_counts",
    "SELECT l_orderkey AS object_id, count_if(l_linestatus = 'F')::BIGINT AS fragments, count_if(l_linestatus <> 'F')::BIGINT AS others, count(DISTINCT l_suppkey)::BIGINT AS backends, sum((round(l_quantity * 1024))::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY l_orderkey",
)
def version_fragment_counts(spark, sf_dir):
    f = locations(spark, sf_dir)
    return f.groupBy("object_id").agg(F.count_if(F.col("state") == "F").alias("fragments"), F.count_if(F.col("state") != "F").alias("others"), F.countDistinct("backend").alias("backends"), F.sum("file_size").alias("bytes"))


@register("list_backups_topk", "SELECT o_orderkey AS object_id, o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS size FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_backups_topk(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("object_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size")).orderBy(F.desc("created_at"), "object_id").limit(50)


@register("distinct_versions", "SELECT DISTINCT turn AS version FROM conversations")
def distinct_versions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("turn").alias("version")).distinct()


@register(
    "stored_bytes_by_backend",
    "SELECT s_name AS backend, n_name AS place, sum((round(l_quantity * 1024))::BIGINT)::BIGINT AS bytes, count(*)::BIGINT AS fragments, count(DISTINCT l_orderkey)::BIGINT AS objects FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
)
def stored_bytes_by_backend(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("backend_id"), F.col("s_name").alias("backend"), "s_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("place"))
    f = locations(spark, sf_dir).withColumnRenamed("backend", "backend_id")
    per = f.groupBy("backend_id").agg(F.sum("file_size").alias("bytes"), F.count(F.lit(1)).alias("fragments"), F.countDistinct("object_id").alias("objects"))
    return per.join(s, "backend_id").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("backend", "place", "bytes", "fragments", "objects")


@register("latest_index", "SELECT l_suppkey AS backend, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS object_id, max(l_shipdate) AS uploaded_at FROM lineitem GROUP BY l_suppkey")
def latest_index(spark, sf_dir):
    f = locations(spark, sf_dir).groupBy("backend").agg(F.max(F.struct("uploaded_at", "object_id", "frag_idx")).alias("x"))
    return f.select("backend", F.col("x.object_id").alias("object_id"), F.col("x.uploaded_at").alias("uploaded_at"))


@register("location_lookup", "SELECT o_orderkey AS object_id, l_linenumber AS frag_idx, l_suppkey AS backend, (round(l_quantity * 1024))::BIGINT AS file_size FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linestatus = 'F'")
def location_lookup(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("object_id"))
    return locations(spark, sf_dir).where("state = 'F'").join(o, "object_id").select("object_id", "frag_idx", "backend", "file_size")


@register(
    "registered_backends",
    "WITH r AS (SELECT lower(n_name) AS k FROM nation WHERE n_regionkey <= 2) SELECT c_custkey AS remote, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) IN (SELECT k FROM r) OR NOT EXISTS (SELECT 1 FROM r)",
)
def registered_backends(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("remote"), F.col("n_name").alias("name"))
    return placement.semi_or_all(c, n.where("n_regionkey <= 2").select(F.upper("n_name").alias("name")), "name")


_STATUS = f"""{OBJECTS}, {blocks_sql(1024, 'b', 'frag_idx')}, e AS (SELECT object_id, frag_idx, CASE WHEN (object_id + frag_idx) % 13 = 5 THEN NULL ELSE sha256(data) END AS hash, data FROM b),
    a AS (SELECT object_id, frag_idx, sha256(CASE WHEN (object_id * 31 + frag_idx * 7) % 97 = 13 THEN data || 'X'::BLOB ELSE data END) AS got FROM b WHERE (object_id + frag_idx) % 11 <> 3),
    s AS (SELECT e.object_id, e.frag_idx, CASE WHEN a.got IS NULL THEN 'missing' WHEN e.hash IS NULL OR e.hash = a.got THEN 'ok' ELSE 'corrupted' END AS status FROM e LEFT JOIN a USING (object_id, frag_idx))"""


def fragment_states(spark, sf_dir):
    b = chunking.split(objects(spark, sf_dir), 1024)
    expected = b.select("object_id", "frag_idx", F.when((F.col("object_id") + F.col("frag_idx")) % 13 != 5, B.digest(F.col("data"))).alias("hash"))
    bad = (F.col("object_id") * 31 + F.col("frag_idx") * 7) % 97 == 13
    available = b.where("(object_id + frag_idx) % 11 <> 3").select("object_id", "frag_idx", B.digest(F.when(bad, F.concat("data", F.lit(b"X"))).otherwise(F.col("data"))).alias("hash"))
    return placement.status(expected, available, ["object_id", "frag_idx"])


@register("fragment_status", f"WITH {_STATUS} SELECT object_id, frag_idx::INTEGER AS frag_idx, status FROM s")
def fragment_status(spark, sf_dir):
    return fragment_states(spark, sf_dir).select("object_id", "frag_idx", "status")


@register("status_summary", f"WITH {_STATUS} SELECT object_id, count_if(status = 'ok')::BIGINT AS ok, count_if(status = 'corrupted')::BIGINT AS corrupted, count_if(status = 'missing')::BIGINT AS missing, count(*)::BIGINT AS total, bool_and(status = 'ok') AS healthy FROM s GROUP BY object_id")
def status_summary(spark, sf_dir):
    s = F.col("status")
    return fragment_states(spark, sf_dir).groupBy("object_id").agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "corrupted").alias("corrupted"), F.count_if(s == "missing").alias("missing"), F.count(F.lit(1)).alias("total"), F.bool_and(s == "ok").alias("healthy"))


@register("corrupt_preview", f"WITH {_STATUS} SELECT object_id, array_to_string((list_sort(list(frag_idx)))[1:5], ',') AS first_bad, count(*)::BIGINT AS bad FROM s WHERE status <> 'ok' GROUP BY object_id")
def corrupt_preview(spark, sf_dir):
    """The first five bad fragments of each object; a report that is cut off by design."""
    bad = fragment_states(spark, sf_dir).where("status <> 'ok'").groupBy("object_id").agg(F.array_sort(F.collect_set("frag_idx")).alias("x"), F.count(F.lit(1)).alias("bad"))
    return bad.select("object_id", F.array_join(F.slice("x", 1, 5), ",").alias("first_bad"), "bad")


@register("fragments_by_prefix", f"WITH {OBJECTS}, {blocks_sql(4096, 'b', 'i')}, n AS (SELECT sha256(content) || '_' || i || '.frag' AS name FROM b JOIN objects USING (object_id)) SELECT regexp_extract(name, '^(.*)_[0-9]+\\.frag$', 1) AS prefix, count(*)::BIGINT AS fragments, max(regexp_extract(name, '_([0-9]+)\\.frag$', 1)::INTEGER)::INTEGER AS last FROM n GROUP BY prefix")
def fragments_by_prefix(spark, sf_dir):
    n = objects(spark, sf_dir).select(F.explode(F.transform(B.cuts(F.octet_length("content"), F.lit(4096)), lambda i: B.fragment_name(B.digest(F.col("content")), i))).alias("name"))
    return n.groupBy(F.regexp_extract("name", r"^(.*)_[0-9]+\.frag$", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("fragments"), F.max(F.regexp_extract("name", r"_([0-9]+)\.frag$", 1).cast("int")).alias("last"))


@register("info_projection", "SELECT o_orderkey AS object_id, '{\"created\":\"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '\",\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}' AS info FROM orders")
def info_projection(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("object_id"), F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("info"))


@register("throughput_medians", "SELECT event_type, median(value) AS median_value, count(*)::BIGINT AS n, max(value) AS most FROM events GROUP BY event_type")
def throughput_medians(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.median("value").alias("median_value"), F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
