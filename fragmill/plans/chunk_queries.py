"""Queries over chunking, naming, predicates, digests and counts of n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import codecs
from ..operators import chunking, dedup
from .catalog import register

OBJECTS = "objects AS (SELECT doc_id AS object_id, encode(text) AS content, octet_length(encode(text)) AS n FROM documents)"


def blocks_sql(size: int, name: str = "blocks", ordinal: str = "block_idx", source: str = "objects") -> str:
    return f"{name} AS (SELECT object_id, i AS {ordinal}, content[i * {size} + 1 : i * {size} + {size}] AS data FROM (SELECT *, unnest(range(0, (n + {size - 1}) // {size})) AS i FROM {source}))"


def objects(spark, sf_dir):
    return chunking.documents_as_objects(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@register(
    "block_dedup",
    f"""WITH {OBJECTS}, {blocks_sql(256)}, h AS (SELECT object_id, block_idx, sha256(data) AS hash FROM blocks),
    o AS (SELECT hash, min(object_id) AS owner FROM h GROUP BY hash)
    SELECT h.object_id, count(*)::BIGINT AS total_blocks, count(DISTINCT h.hash)::BIGINT AS distinct_blocks,
           count_if(o.owner = h.object_id)::BIGINT AS own_blocks
    FROM h JOIN o USING (hash) GROUP BY h.object_id""",
)
def block_dedup(spark, sf_dir):
    h = chunking.split(objects(spark, sf_dir), 256, ordinal="block_idx").select("object_id", "block_idx", B.digest(F.col("data")).alias("hash"))
    counts = h.groupBy("object_id", "hash").agg(F.count(F.lit(1)).alias("n"))  # both sides below start from its one exchange
    per = counts.join(counts.groupBy("hash").agg(F.min("object_id").alias("owner")), "hash")
    return per.groupBy("object_id").agg(F.sum("n").alias("total_blocks"), F.count(F.lit(1)).alias("distinct_blocks"), F.sum(F.when(F.col("owner") == F.col("object_id"), F.col("n")).otherwise(0)).alias("own_blocks"))


@register("object_fingerprint", "SELECT doc_id AS object_id, sha256(encode(text)) AS fingerprint, octet_length(encode(text))::BIGINT AS file_size FROM documents")
def object_fingerprint(spark, sf_dir):
    return objects(spark, sf_dir).select("object_id", B.digest(F.col("content")).alias("fingerprint"), F.octet_length("content").cast("long").alias("file_size"))


@register("fragment_hashes", f"WITH {OBJECTS}, {blocks_sql(1024, 'f', 'frag_idx')} SELECT object_id, frag_idx::INTEGER AS frag_idx, octet_length(data)::INTEGER AS size, sha256(data) AS hash FROM f")
def fragment_hashes(spark, sf_dir):
    return chunking.split(objects(spark, sf_dir), 1024).select("object_id", "frag_idx", "size", B.digest(F.col("data")).alias("hash"))


@register(
    "adaptive_fragment_size",
    """WITH n AS (SELECT p_partkey AS object_id, (p_retailprice * 1000)::BIGINT * p_size * 100 AS file_size FROM part)
    SELECT object_id, file_size, least(greatest(file_size // 50, 262144), 67108864)::BIGINT AS fragment_size,
           ((file_size + least(greatest(file_size // 50, 262144), 67108864) - 1) // least(greatest(file_size // 50, 262144), 67108864))::BIGINT AS fragment_count,
           CASE WHEN file_size <= 102400 THEN 256 WHEN file_size <= 1048576 THEN 256 WHEN file_size <= 10485760 THEN 512 WHEN file_size <= 209715200 THEN 1024 WHEN file_size <= 1073741824 THEN 2048 ELSE 4096 END AS block_size,
           CASE WHEN file_size <= 10485760 THEN 256 WHEN file_size <= 209715200 THEN 512 WHEN file_size <= 1073741824 THEN 1024 ELSE 2048 END AS block_size_rows,
           CASE WHEN file_size <= 209715200 THEN 256 WHEN file_size <= 1073741824 THEN 512 ELSE 1024 END AS block_size_cross
    FROM n""",
)
def adaptive_fragment_size(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("object_id"), (F.round(F.col("p_retailprice") * 1000).cast("long") * F.col("p_size") * 100).alias("file_size"))
    size = B.fragment_size(F.col("file_size"))
    return n.select("object_id", "file_size", size.alias("fragment_size"), B.fragment_count(F.col("file_size"), size).alias("fragment_count"), B.block_size(F.col("file_size")).alias("block_size"), B.block_size(F.col("file_size"), "FSS3").alias("block_size_rows"), B.block_size(F.col("file_size"), "FSS5").alias("block_size_cross"))


@register(
    "grown_block_size",
    """WITH n AS (SELECT o_orderkey AS object_id, (o_totalprice * 4000)::BIGINT AS file_size FROM orders),
    s AS (SELECT object_id, file_size, unnest([256, 512, 1024, 2048, 4096, 8192, 16384]) AS size FROM n)
    SELECT object_id, file_size, coalesce(min(size) FILTER ((file_size + size - 1) // size <= 60000), 16384)::INTEGER AS block_size FROM s GROUP BY ALL""",
)
def grown_block_size(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("object_id"), F.round(F.col("o_totalprice") * 4000).cast("long").alias("file_size"))
    return n.withColumn("block_size", B.grown_block_size(F.col("file_size"), F.lit(256)))


@register(
    "fragment_names",
    f"""WITH {OBJECTS}, f AS (SELECT object_id, sha256(content) AS fp, unnest(range(0, (n + 4095) // 4096)) AS i FROM objects)
    SELECT object_id, i::INTEGER AS frag_idx, fp || '_' || i || '.frag' AS filename, fp || '_v1_' || i || '.frag' AS remote_path,
           left(fp, 12) || '...' || right(fp, 8) AS short FROM f""",
)
def fragment_names(spark, sf_dir):
    f = objects(spark, sf_dir).select("object_id", B.digest(F.col("content")).alias("fp"), F.explode(B.cuts(F.octet_length("content"), F.lit(4096))).alias("frag_idx"))
    return f.select("object_id", "frag_idx", B.fragment_name(F.col("fp"), F.col("frag_idx")).alias("filename"), B.remote_path(F.col("fp"), F.lit(1), F.col("frag_idx")).alias("remote_path"), B.abbreviated(F.col("fp")).alias("short"))


@register(
    "human_sizes",
    """WITH n AS (SELECT o_orderkey AS object_id, (o_totalprice * 100)::BIGINT AS b FROM orders)
    SELECT object_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KiB', (b * 100 + 512) // 1024 / 100.0) WHEN b < 1073741824 THEN printf('%.2f MiB', (b * 100 + 524288) // 1048576 / 100.0) ELSE printf('%.2f GiB', b / 1073741824.0) END AS iec,
           CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN printf('%.2f KB', (b * 100 + 500) // 1000 / 100.0) WHEN b < 1000000000 THEN printf('%.2f MB', (b * 100 + 500000) // 1000000 / 100.0) ELSE printf('%.2f GB', b / 1000000000.0) END AS si FROM n""",
)
def human_sizes(spark, sf_dir):
    b = F.round(F.col("o_totalprice") * 100).cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("object_id"), b.alias("b")).select("object_id", B.human_size(F.col("b")).alias("iec"), B.human_size(F.col("b"), True).alias("si"))


@register(
    "path_predicates",
    r"""SELECT page_id, url, NOT regexp_matches(url, '(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:|\x00') AND length(url) > 0 AS safe,
           lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages""",
)
def path_predicates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", B.safe_path(F.col("url")).alias("safe"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))


_HEADS = "|".join(B.COMPRESSED_HEADS)


@register(
    "looks_compressed",
    f"""WITH d AS (SELECT doc_id AS object_id, CASE doc_id % 5 WHEN 0 THEN from_hex('1F8B08') WHEN 1 THEN from_hex('28B52FFD') WHEN 2 THEN from_hex('504B0304') WHEN 3 THEN from_hex('04224D18') ELSE ''::BLOB END || encode(text) AS data FROM documents)
    SELECT object_id, regexp_matches(hex(data[1:8]), '^({_HEADS})') AS compressed,
           CASE WHEN starts_with(hex(data[1:4]), '04224D18') THEN 'lz4' WHEN starts_with(hex(data[1:4]), '28B52FFD') OR hex(data[9:12]) = '28B52FFD' THEN 'zstd' WHEN starts_with(hex(data[1:2]), '1F8B') THEN 'gzip' WHEN starts_with(hex(data[1:3]), '434B43') THEN 'ckc' ELSE 'none' END AS frame
    FROM d""",
)
def looks_compressed(spark, sf_dir):
    heads = F.element_at(F.array(*map(F.lit, ("1F8B08", "28B52FFD", "504B0304", "04224D18", ""))), (F.col("object_id") % 5 + 1).cast("int"))
    d = objects(spark, sf_dir).select("object_id", F.concat(F.unhex(heads), "content").alias("data"))
    return d.select("object_id", B.looks_compressed(F.col("data")).alias("compressed"), B.frame_of(F.col("data")).alias("frame"))


@register(
    "hash_truncations",
    f"""WITH {OBJECTS}, {blocks_sql(256)}
    SELECT object_id, block_idx::INTEGER AS block_idx, left(sha256(data), 4) AS h2, left(sha256(data), 16) AS h8,
           replace(replace(rtrim(to_base64(from_hex(left(sha256(data), 16))), '='), '+', '-'), '/', '_') AS h8_text FROM blocks""",
)
def hash_truncations(spark, sf_dir):
    h = chunking.split(objects(spark, sf_dir), 256, ordinal="block_idx").select("object_id", "block_idx", B.digest(F.col("data")).alias("h"))
    return h.select("object_id", "block_idx", F.left("h", F.lit(4)).alias("h2"), F.left("h", F.lit(16)).alias("h8"), B.url_base64(F.unhex(F.left("h", F.lit(16)))).alias("h8_text"))


@register("object_checksums")
def object_checksums(spark, sf_dir):
    """CRC-32 natively; Adler-32, CRC-8 and the 128- and 64-bit digests over Arrow batches."""
    c = F.col("content")
    return objects(spark, sf_dir).select("object_id", F.crc32(c).alias("crc32"), codecs.adler(c).alias("adler32"), codecs.crc8(c).alias("crc8"), codecs.xxh128(c).alias("xxh128"), codecs.xxh64_low(c).alias("entropy"))


@register(
    "dictionary_ngrams",
    f"""WITH {OBJECTS}, g AS (SELECT hex(content[i + 1 : i + 8]) AS gram FROM (SELECT content, unnest(range(0, n - 7)) AS i FROM objects))
    SELECT gram, count(*)::BIGINT AS freq, (count(*) * 8)::BIGINT AS score FROM g GROUP BY gram HAVING count(*) >= 2 ORDER BY score DESC, gram LIMIT 4096""",
)
def dictionary_ngrams(spark, sf_dir):
    """A dictionary of 32 KiB: the 8-byte n-grams that save most.  The limit is the dictionary's size."""
    o = objects(spark, sf_dir).where(F.octet_length("content") >= 8).select(F.regexp_extract_all(F.hex("content"), F.lit(".."), F.lit(0)).alias("x"))
    g = o.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("x") - 7), lambda i: F.array_join(F.slice("x", i, F.lit(8)), ""))).alias("gram"))
    counts = g.groupBy("gram").agg(F.count(F.lit(1)).alias("freq")).where("freq >= 2")
    return counts.withColumn("score", F.col("freq") * 8).orderBy(F.desc("score"), "gram").limit(4096)


@register(
    "dedup_map",
    f"""WITH {OBJECTS}, {blocks_sql(256)}, h AS (SELECT object_id, block_idx, sha256(data) AS hash FROM blocks)
    SELECT hash, min((object_id, block_idx))[1]::BIGINT AS owner_object_id, min((object_id, block_idx))[2]::INTEGER AS owner_block_idx, count(*)::BIGINT AS ref_count FROM h GROUP BY hash""",
)
def dedup_map(spark, sf_dir):
    h = chunking.split(objects(spark, sf_dir), 256, ordinal="block_idx").select("object_id", "block_idx", B.digest(F.col("data")).alias("hash"))
    return dedup.owners(h, order=("object_id", "block_idx"))


@register("merged_hash", f"WITH {OBJECTS} SELECT object_id, sha256(content) AS original_hash, sha256(content) AS merged_hash, true AS equal FROM objects WHERE n > 0")
def merged_hash(spark, sf_dir):
    """Fragments put together again in order and held against the object's digest."""
    o = objects(spark, sf_dir)
    back = chunking.merged(chunking.split(o, 1024), ["object_id"])
    return o.select("object_id", B.digest(F.col("content")).alias("original_hash")).join(back, "object_id").select("object_id", "original_hash", B.digest(F.col("content")).alias("merged_hash"), (B.digest(F.col("content")) == F.col("original_hash")).alias("equal"))
