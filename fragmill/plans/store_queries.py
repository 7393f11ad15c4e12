"""Queries over stores: transfers, pushes that record, listings, factories, canonical forms, batches of states, files."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aes, ctr
from ..functions import bytes as B
from ..operators import dedup, placement, unified
from ..sources import cbor, container, readers, storage
from .catalog import register
from .diff_queries import pairs
from .placement_queries import _B, _STATUS, backends, fragment_states


def _expected(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("i")).distinct()
    f = li.select("object_id", F.lit("fragment").alias("part"), F.concat_ws("_", F.col("object_id").cast("string"), F.col("i").cast("string")).alias("name"))
    o = li.select("object_id").distinct()
    return f, o.select("object_id", F.lit("index").alias("part"), F.concat(F.col("object_id").cast("string"), F.lit(".idx")).alias("name")), o.select("object_id", F.lit("rc").alias("part"), F.concat(F.col("object_id").cast("string"), F.lit(".rc")).alias("name"))


@register(
    "transfer_plan",
    """WITH f AS (SELECT DISTINCT l_orderkey AS object_id, l_linenumber AS i FROM lineitem), o AS (SELECT DISTINCT object_id FROM f)
    SELECT object_id, 'fragment' AS part, object_id || '_' || i AS name, 0 AS step, CASE WHEN (object_id + i) % 11 <> 3 THEN 'move' ELSE 'skip' END AS action FROM f
    UNION ALL SELECT object_id, 'index', object_id || '.idx', 1, 'move' FROM o UNION ALL SELECT object_id, 'rc', object_id || '.rc', 2, CASE WHEN object_id % 2 = 0 THEN 'copy' ELSE 'skip' END FROM o""",
)
def transfer_plan(spark, sf_dir):
    """What moves from one store to another, in which step; some fragments and half of the containers are not there."""
    f, index, rc = _expected(spark, sf_dir)
    number = F.element_at(F.split("name", "_"), -1).cast("long")
    present = f.where((F.col("object_id") + number) % 11 != 3).select("name").union(index.select("name")).union(rc.where("object_id % 2 = 0").select("name"))
    return storage.transfer_plan(f.unionByName(index).unionByName(rc), present)


@register(
    "push_recorded",
    f"""WITH {_B.format(where='')}, l AS (SELECT DISTINCT l_orderkey AS object_id, l_linenumber AS frag_idx, l_linestatus = 'F' AS held FROM lineitem), h AS (SELECT object_id, frag_idx, bool_or(held) AS held FROM l GROUP BY ALL)
    SELECT h.object_id, h.frag_idx, b.name AS backend, NOT held AS pushed FROM h JOIN b ON h.frag_idx % b.number = b.ordinal""",
)
def push_recorded(spark, sf_dir):
    """The catalogue after a push: located fragments stay, the others are placed and recorded."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("frag_idx"), "l_linestatus")  # noqa: E741
    local = l.select("object_id", "frag_idx").distinct()
    b = placement.candidates(backends(spark, sf_dir))
    located = placement.placed(l.where("l_linestatus = 'F'").select("object_id", "frag_idx").distinct(), b)
    return placement.pushed(local, located, b)


@register("pull_list", "SELECT turn AS version, count(*)::BIGINT AS files, count_if(conv_id % 5 = 0 OR conv_id % 7 = 0)::BIGINT AS to_pull, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY turn ORDER BY turn")
def pull_list(spark, sf_dir):
    """The listing of a pull: per version the files, those absent or different here, and their bytes, versions ascending."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("version"), "text")
    catalog = c.select("conv_id", "version", B.digest(B.octets(F.col("text"))).alias("catalog_hash"), F.octet_length("text").alias("n"))
    local = c.where("conv_id % 5 <> 0").select("conv_id", "version", B.digest(B.octets(F.concat("text", F.when(F.col("conv_id") % 7 == 0, "X").otherwise("")))).alias("local_hash"))
    return placement.pull_list(catalog, local, ["conv_id", "version"], "version")


_FACTORIES = [("automobile", "path"), ("BUILDING", "rest"), ("Furniture", "key"), ("none", "native")]


@register(
    "backend_factories",
    f"WITH f(kind, factory) AS (VALUES {', '.join(map(repr, _FACTORIES))}) SELECT c_custkey AS remote, c_mktsegment AS kind, factory FROM customer LEFT JOIN f ON lower(c_mktsegment) = lower(f.kind)",
)
def backend_factories(spark, sf_dir):
    """Configured remotes meet the factory of their kind, in either case; null where none is registered."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("remote"), F.col("c_mktsegment").alias("kind"))
    return placement.with_factories(c, spark.createDataFrame(_FACTORIES, "kind string, factory string"))


@register("backups_by_key", "SELECT sha256(o_custkey::VARCHAR) AS key, count(*)::BIGINT AS backups, count(DISTINCT o_orderstatus)::BIGINT AS states FROM orders GROUP BY ALL")
def backups_by_key(spark, sf_dir):
    """For every password key the number of backups under it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.sha2(F.col("o_custkey").cast("string"), 256).alias("key")).agg(F.count(F.lit(1)).alias("backups"), F.countDistinct("o_orderstatus").alias("states"))


@register(
    "section_order",
    "WITH s AS (SELECT CASE WHEN r_regionkey = 0 THEN '' ELSE r_name END AS section, n_name AS key FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT section, key, (row_number() OVER (ORDER BY section <> '', section, key))::INTEGER AS place FROM s",
)
def section_order(spark, sf_dir):
    """Entries of a settings file in order: the global section first, then sections and keys by name."""
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    s = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.when(F.col("r_regionkey") == 0, "").otherwise(F.col("r_name")).alias("section"), F.col("n_name").alias("key"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.col("section") != "", "section", "key")))  # a settings file's few keys


@register(
    "index_union",
    "WITH a AS (SELECT l_orderkey AS object_id, l_linenumber AS i FROM lineitem WHERE l_linestatus = 'F' UNION SELECT l_orderkey, l_linenumber + l_linenumber % 2 FROM lineitem WHERE l_returnflag = 'N') SELECT object_id, array_to_string(list_sort(list(i)), ',') AS indices FROM a GROUP BY ALL",
)
def index_union(spark, sf_dir):
    """The union of two lists of fragment places, per object."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    a = l.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("object_id")).agg(F.collect_set("l_linenumber").alias("a"))
    b = l.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("object_id")).agg(F.collect_set(F.col("l_linenumber") + F.col("l_linenumber") % 2).alias("b"))
    none = F.expr("cast(array() as array<int>)")
    both = a.join(b, "object_id", "full").select("object_id", F.array_union(F.coalesce("a", none), F.coalesce("b", none)).alias("x"))
    return both.select("object_id", F.array_join(F.array_sort("x"), ",").alias("indices"))


@register(
    "canonical_hashes",
    "SELECT o_orderkey AS object_id, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS hash, true AS same FROM orders",
)
def canonical_hashes(spark, sf_dir):
    """An index's digest leaves out its validation fields: two indexes that differ in these alone have one."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("object_id"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("fss6_maps"), F.col("o_orderdate").alias("fss61_repair"))
    before, after = placement.canonical(o.drop("fss6_maps", "fss61_repair")), placement.canonical(o)
    return before.withColumnRenamed("hash", "_h").join(after, "object_id").select("object_id", "hash", (F.col("_h") == F.col("hash")).alias("same"))


@register(
    "dictionary_short",
    """WITH p AS (SELECT p_partkey AS i, encode(p_name || ' ' || p_partkey) AS c FROM part WHERE p_size = 1), g AS (SELECT 8 AS n, hex(c[k + 1 : k + 8]) AS gram FROM (SELECT c, unnest(range(0, octet_length(c) - 7)) AS k FROM p) UNION ALL SELECT 4, hex(c[k + 1 : k + 4]) FROM (SELECT c, unnest(range(0, octet_length(c) - 3)) AS k FROM p)),
    a AS (SELECT n, gram, count(*)::BIGINT AS freq FROM g GROUP BY ALL), k AS (SELECT * FROM a WHERE n = 8 AND freq >= 100000 UNION ALL SELECT * FROM a WHERE n = 4 AND freq >= 3 AND NOT EXISTS (SELECT 1 FROM a WHERE n = 8 AND freq >= 100000))
    SELECT gram, freq, (freq * n)::BIGINT AS score FROM k ORDER BY score DESC, gram LIMIT 512""",
)
def dictionary_short(spark, sf_dir):
    """Too few long n-grams repeat often enough here, so the dictionary is made of those of four bytes."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size = 1").select(B.octets(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("content"))
    return dedup.dictionary(p, least=(100_000, 3), entries=512)


@register(
    "status_batches",
    f"""WITH {_STATUS}, g AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY frag_idx) - row_number() OVER (PARTITION BY object_id, status = 'ok' ORDER BY frag_idx) AS island FROM s)
    SELECT object_id, min(frag_idx)::INTEGER AS first, count(*)::BIGINT AS rows, status = 'ok' AS kept, count_if(status = 'missing')::BIGINT AS missing FROM g GROUP BY object_id, island, status = 'ok' HAVING NOT (status = 'ok' AND count(*) <= 2)""",
)
def status_batches(spark, sf_dir):
    """Runs of good and of bad fragments; good runs of one or two are left out."""
    s = fragment_states(spark, sf_dir).withColumn("kept", F.col("status") == "ok")
    runs = placement.batches(s, ["object_id"], "frag_idx", "kept")
    out = runs.groupBy("object_id", "batch", "kept").agg(F.min("frag_idx").alias("first"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "missing").alias("missing"))
    return out.where("not (kept and rows <= 2)").select("object_id", "first", "rows", "kept", "missing")


@register("unified_diff")
def unified_diff(spark, sf_dir):
    """Unified diffs of consecutive documents: counts, the number of batches and the text's digest."""
    old, new = pairs(spark, sf_dir)
    p = old.select("pair_id", B.octets(F.col("text")).alias("old")).join(new.select("pair_id", B.octets(F.col("text")).alias("new")), "pair_id", "full")
    d = unified.unified_diffs(p)
    return d.select("pair_id", "added_lines", "removed_lines", "changed_lines", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^@@ -\d+ \+\d+ @@$"), F.lit(0))).alias("batches"), F.sha2("text", 256).alias("hash"))


@register(
    "version_pair_diff",
    """WITH v AS (SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS n, strlen(text) AS size FROM conversations)
    SELECT a.conv_id AS object_id, a.n::BIGINT AS old, b.n::BIGINT AS new, CASE WHEN b.n = a.n + 1 THEN 'stored' ELSE 'restored' END AS source, greatest(b.size - a.size, 0)::BIGINT AS added_bytes, greatest(a.size - b.size, 0)::BIGINT AS removed_bytes
    FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n + 1 AND a.n + 2""",
)
def version_pair_diff(spark, sf_dir):
    """Diffs of neighbouring versions come from the records, those two apart from both restored versions."""
    w = Window.partitionBy("object_id").orderBy("n")
    v = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("object_id"), F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("n"), F.octet_length("text").cast("long").alias("size"))
    ahead = v.select("object_id", F.col("n").alias("old"), F.col("size").alias("a"), F.array(*(F.struct(F.lit(s).alias("source"), F.lead("n", k).over(w).alias("new"), F.lead("size", k).over(w).alias("b")) for k, s in ((1, "stored"), (2, "restored")))).alias("xs"))
    rows = ahead.select("object_id", "old", "a", F.explode("xs").alias("x")).where("x.new is not null")
    return rows.select("object_id", "old", "x.new", "x.source", F.greatest(F.col("x.b") - F.col("a"), F.lit(0)).alias("added_bytes"), F.greatest(F.col("a") - F.col("x.b"), F.lit(0)).alias("removed_bytes"))


def _folder(spark) -> str:
    """A new folder that all executors share."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{conf.rstrip('/')}/store-{os.urandom(8).hex()}"


@register(
    "store_and_fetch",
    "SELECT 'Supplier#' || (s_suppkey % 10) AS object_id, count(*)::BIGINT AS fragments, 0::BIGINT AS failed, sha256(string_agg(s_name, '' ORDER BY s_suppkey)) AS hash FROM supplier GROUP BY 1",
)
def store_and_fetch(spark, sf_dir):
    """Pieces written to two backends, fetched again by their locations and put together in order."""
    root = _folder(spark)
    stores = spark.createDataFrame([("A", "path", f"{root}/a"), ("B", "PATH", f"{root}/b")], "name string, kind string, uri string")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("Supplier#"), (F.col("s_suppkey") % 10).cast("string")).alias("object_id"), F.col("s_suppkey").alias("frag_idx"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".frag")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b").alias("backend"), B.octets(F.col("s_name")).alias("data"))
    written = storage.stored(s.join(F.broadcast(stores.select(F.lower("name").alias("backend"), "kind", "uri")), "backend"))  # two rows
    failed = written.where("error is not null").count()
    if failed:
        raise OSError(f"{failed} pieces were not written")
    got = storage.objects_read(s.select("object_id", "frag_idx", "name", "backend"), stores)
    return got.select("object_id", "fragments", "failed", B.digest(F.col("content")).alias("hash"))


def _stored(spark, files, suffix: str) -> str:
    """Writes files (i, data) as <i><suffix> into a new folder, which is returned."""
    root = f"{_folder(spark)}/files"
    rows = files.select(F.lit("path").alias("kind"), F.lit(root).alias("uri"), F.concat(F.col("i").cast("string"), F.lit(suffix)).alias("name"), "data")
    if failed := storage.stored(rows).where("error is not null").count():
        raise OSError(f"{failed} files were not written")
    return root


_ROUNDS = 10


@register(
    "index_files",
    "SELECT r_regionkey || '.idx' AS name, r_name AS original_name, (r_regionkey * 100)::BIGINT AS file_size, r_regionkey::INTEGER AS fragment_count FROM region",
)
def index_files(spark, sf_dir):
    """Sealed index files of a folder, found, opened with a password and decoded; every other one has the older key."""

    @F.pandas_udf("binary")
    def made(i: pd.Series, name: pd.Series) -> pd.Series:
        out = []
        for k, n in zip(map(int, i), name):
            d = cbor.index_document({"version": 1, "original_name": n, "file_size": k * 100, "fragments": [{"size": 1}] * k})
            out.append(readers.sealed_index(d, "pw", bytes([k]) * 32, bytes(12), _ROUNDS) if k % 2 else bytes(12) + ctr.crypt(d, bytes(12), aes.legacy_key("pw")))
        return pd.Series(out)

    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("i"), "r_name")
    root = _stored(spark, r.select("i", made("i", "r_name").alias("data")), ".idx")
    return readers.indexes(readers.files(spark, root, "*.idx"), "pw", _ROUNDS).select("name", "original_name", "file_size", "fragment_count")


@register(
    "container_files",
    "SELECT n_nationkey || '.rc' AS name, n_name AS file_fingerprint, (n_regionkey + 1)::INTEGER AS index_blocks, (n_nationkey % 3)::INTEGER AS fragments, (2 * (n_nationkey % 3))::INTEGER AS fragment_blocks, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END::INTEGER AS repair_a_blocks FROM nation",
)
def container_files(spark, sf_dir):
    """Recovery containers of a folder, decoded; half of them hold repair data."""

    @F.pandas_udf("binary")
    def made(i: pd.Series, name: pd.Series, region: pd.Series) -> pd.Series:
        return pd.Series([readers.container_document({"version": 1, "file_fingerprint": n, "index_block_map": ["x"] * (int(r) + 1), "fragment_block_maps": [["a", "b"]] * (int(k) % 3), "created_at": int(k), "repair_a": None if k % 2 else {"seed": 1, "block_count": int(k), "block_size": 4, "data": b"d"}}) for k, n, r in zip(i, name, region)])

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("i"), made("n_nationkey", "n_name", "n_regionkey").alias("data"))
    found = readers.files(spark, _stored(spark, n, ".rc"), "*.rc")
    return readers.containers(found).select("name", "file_fingerprint", "index_blocks", "fragments", "fragment_blocks", "repair_a_blocks")


@register(
    "rescue_indexes",
    "SELECT n_name AS prefix, 3::BIGINT AS fragments, (n_nationkey % 2)::INTEGER AS probe, n_name || '.txt' AS original_name FROM nation",
)
def rescue_indexes(spark, sf_dir):
    """Indexes found without index files: the first fragment of each object whose header is whole carries one."""

    @F.pandas_udf("binary")
    def made(k: pd.Series, i: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([b"junk" if i_ == 0 and k_ % 2 else container.fragment_file({"original_name": f"{n}.txt"}, b"data", bytes(12)) for k_, i_, n in zip(k, i, name)])

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, range(3)))).alias("p"))
    files = n.select(F.concat_ws("_", "n_name", F.col("p").cast("string")).alias("i"), made("n_nationkey", "p", "n_name").alias("data"))
    found = readers.rescued(container.scanned(spark, _stored(spark, files, ".frag")))
    opened = container.index_and_payload(container.parsed(found.drop("name")), "body")
    return container.decoded_indexes(opened).select("prefix", "fragments", "probe", "original_name")
