"""Queries over differences: consecutive documents and turns are versions of one file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import diffs
from .catalog import register


def pairs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 2).cast("long").alias("pair_id"), (F.col("doc_id") % 2).alias("side"), "text")
    return d.where("side = 0").drop("side"), d.where("side = 1").drop("side")


_LINES = """l AS (SELECT doc_id // 2 AS pair_id, doc_id % 2 AS side, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, line ORDER BY line_no) AS k FROM l),
    m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.line, b.line) AS line, a.line_no AS old_no, b.line_no AS new_no FROM (SELECT * FROM k WHERE side = 0) a FULL JOIN (SELECT * FROM k WHERE side = 1) b ON a.pair_id = b.pair_id AND a.line = b.line AND a.k = b.k)"""


@register("line_diff", f"WITH {_LINES} SELECT pair_id, CASE WHEN new_no IS NULL THEN 'Deletion' WHEN old_no IS NULL THEN 'Addition' ELSE 'Context' END AS type, sha256(line) AS line_hash, old_no::INTEGER AS old_no, new_no::INTEGER AS new_no FROM m")
def line_diff(spark, sf_dir):
    old, new = pairs(spark, sf_dir)
    out = diffs.matched_lines(diffs.lines(old, ["pair_id"]), diffs.lines(new, ["pair_id"]), ["pair_id"])
    return out.select("pair_id", "type", F.sha2("line", 256).alias("line_hash"), "old_no", "new_no")


@register(
    "line_diff_stat",
    f"WITH {_LINES} SELECT pair_id, count_if(old_no IS NULL)::BIGINT AS added_lines, count_if(new_no IS NULL)::BIGINT AS removed_lines, greatest(count_if(old_no IS NULL), count_if(new_no IS NULL))::BIGINT AS changed_lines, count_if(old_no IS NOT NULL AND new_no IS NOT NULL)::BIGINT AS kept_lines FROM m GROUP BY pair_id",
)
def line_diff_stat(spark, sf_dir):
    old, new = pairs(spark, sf_dir)
    return diffs.line_counters(diffs.matched_lines(diffs.lines(old, ["pair_id"]), diffs.lines(new, ["pair_id"]), ["pair_id"]), ["pair_id"])


@register(
    "common_ends",
    """WITH p AS (SELECT a.doc_id // 2 AS pair_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0),
    q AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i : x[i] = y[i]), false) - 1, least(len(x), len(y))) AS prefix FROM p)
    SELECT pair_id, prefix::INTEGER AS prefix, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) - prefix + 1), lambda i : x[len(x) + 1 - i] = y[len(y) + 1 - i]), false) - 1, least(len(x), len(y)) - prefix)::INTEGER AS suffix FROM q""",
)
def common_ends(spark, sf_dir):
    old, new = pairs(spark, sf_dir)
    p = old.withColumnRenamed("text", "a").join(new.withColumnRenamed("text", "b"), "pair_id")
    x, y = F.split("a", F.lit("\n"), -1), F.split("b", F.lit("\n"), -1)
    prefix, suffix = diffs.common_ends(F.col("x"), F.col("y"))
    return p.select("pair_id", x.alias("x"), y.alias("y")).select("pair_id", prefix.alias("prefix"), suffix.alias("suffix"))


@register(
    "binary_size_diff",
    "SELECT a.doc_id // 2 AS pair_id, greatest(strlen(b.text) - strlen(a.text), 0)::INTEGER AS added_bytes, greatest(strlen(a.text) - strlen(b.text), 0)::INTEGER AS removed_bytes, CASE WHEN strlen(a.text) > 0 THEN abs(strlen(b.text) - strlen(a.text)) / strlen(a.text) ELSE 0.0 END AS change_ratio FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0",
)
def binary_size_diff(spark, sf_dir):
    old, new = pairs(spark, sf_dir)
    p = old.withColumnRenamed("text", "a").join(new.withColumnRenamed("text", "b"), "pair_id")
    return p.select("pair_id", *diffs.size_change(F.octet_length("a"), F.octet_length("b")))


@register(
    "diff_strategy",
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext, CASE page_id % 4 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '[core]' || chr(10) || 'a=1' WHEN 2 THEN chr(1) || 'x' ELSE html END AS head FROM pages),
    s AS (SELECT page_id, [CASE WHEN ext = 'json' THEN 1.0 WHEN regexp_matches(head, '^\s*[\{\[]') AND NOT regexp_matches(head, '^\s*\[[^\n]*\]\s*(\n|$)') THEN 0.95 ELSE 0.0 END,
        CASE WHEN ext IN ('ini', 'cfg', 'conf') THEN 1.0 WHEN regexp_matches(head, '^\s*\[[^\n]*\]\s*(\n|$)') THEN 0.8 ELSE 0.0 END,
        CASE WHEN regexp_matches(ext, '^(png|jpg|jpeg|gif|bmp|webp|tiff)$') THEN 1.0 ELSE 0.0 END, CASE WHEN regexp_matches(ext, '^(mp3|flac|ogg|wav|m4a|mp4)$') THEN 1.0 ELSE 0.0 END,
        CASE WHEN regexp_matches(ext, '^(txt|md|html|htm|css|js|xml|csv|log|py|cs|yaml|yml)$') THEN 1.0 WHEN NOT regexp_matches(head, '[\x00-\x08\x0E-\x1F]') THEN 0.9 ELSE 0.0 END, 0.01]::DOUBLE[] AS v FROM p)
    SELECT page_id, ['json', 'ini', 'image', 'media', 'text', 'binary'][list_position(v, list_max(v))] AS strategy, list_max(v) AS score FROM s""",
)
def diff_strategy(spark, sf_dir):
    heads = F.when(F.col("page_id") % 4 == 0, '{"a":1}').when(F.col("page_id") % 4 == 1, "[core]\na=1").when(F.col("page_id") % 4 == 2, "\x01x").otherwise(F.col("html"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), heads.alias("head"))
    name, score = diffs.strategy(F.col("ext"), F.col("head"))
    return p.select("page_id", name.alias("strategy"), score.alias("score"))


def configs(spark, sf_dir):
    """Two INI versions of each customer's settings."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, s = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    old = c.select("c_custkey", F.concat(F.lit("; made\n[Main]\nname = "), F.col("c_name"), F.lit("\nSegment="), s, F.lit("\n[limits]\nmax = 10\n")).alias("text"))
    new = c.select("c_custkey", F.concat(F.lit("[main]\nName = "), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "\nsegment = OTHER").when(F.col("c_custkey") % 3 == 1, "").otherwise(F.concat(F.lit("\nsegment = "), s)), F.lit("\n[limits]\nmax = 10\nmin = "), k).alias("text"))
    return old, new


@register(
    "ini_diff",
    """SELECT c_custkey, 'main' AS section, 'segment' AS key, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'removed' END AS change, c_mktsegment AS old, CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' END AS new FROM customer WHERE c_custkey % 3 <> 2
    UNION ALL SELECT c_custkey, 'limits', 'min', 'added', NULL, c_custkey::VARCHAR FROM customer""",
)
def ini_diff(spark, sf_dir):
    old, new = configs(spark, sf_dir)
    keys = ["c_custkey", "section", "key"]
    return diffs.key_changes(diffs.ini_entries(old, ["c_custkey"]), diffs.ini_entries(new, ["c_custkey"]), keys).select(*keys, "change", "old", "new")


@register(
    "json_diff",
    """WITH e AS (SELECT event_id, props, '{"x":{"y":[1,' || event_id || ']},"type":"' || event_type || '"}' AS old, '{"x":{"y":[1,' || (event_id + event_id % 2) || ',3]},"kind":"' || event_type || '"}' AS new FROM events)
    SELECT event_id, '$.x.y[1]' AS path, 'changed' AS change, event_id::VARCHAR AS old, (event_id + 1)::VARCHAR AS new FROM e WHERE event_id % 2 = 1
    UNION ALL SELECT event_id, '$.x.y[2]', 'added', NULL, '3' FROM e
    UNION ALL SELECT event_id, '$.type', 'removed', '"' || json_extract_string(old, '$.type') || '"', NULL FROM e
    UNION ALL SELECT event_id, '$.kind', 'added', NULL, '"' || json_extract_string(new, '$.kind') || '"' FROM e""",
)
def json_diff(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    old = e.select("event_id", F.concat(F.lit('{"x":{"y":[1,'), i.cast("string"), F.lit(']},"type":"'), "event_type", F.lit('"}')).alias("text"))
    new = e.select("event_id", F.concat(F.lit('{"x":{"y":[1,'), (i + i % 2).cast("string"), F.lit(',3]},"kind":"'), "event_type", F.lit('"}')).alias("text"))
    keys = ["event_id", "path"]
    return diffs.key_changes(diffs.json_entries(old, ["event_id"]), diffs.json_entries(new, ["event_id"]), keys).select(*keys, "change", "old", "new")


@register("event_props", "SELECT event_id, k AS key, json_extract(props, '$.' || k)::VARCHAR AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def event_props(spark, sf_dir):
    """The fields of each event's JSON properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.explode(F.try_variant_get(F.try_parse_json("props"), F.lit("$"), "map<string,variant>")).alias("key", "v"))
    return e.select("event_id", "key", F.to_json("v").alias("value"))


@register(
    "side_by_side",
    """SELECT event_id, unnest([0, 1, 2, 3, 4])::INTEGER AS row, unnest([NULL, event_id, event_id + 1, NULL, event_id + 2])::INTEGER AS left_no, unnest([NULL, 'same', 'old', NULL, 'end']) AS left,
    unnest([NULL, 7, NULL, 8, 9])::INTEGER AS right_no, unnest([NULL, 'same', NULL, event_type, 'end']) AS right FROM events""",
)
def side_by_side(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = e.select("event_id", F.concat(F.lit("@@ -"), F.col("event_id").cast("string"), F.lit(" +7 @@\n same\n-old\n+"), "event_type", F.lit("\n end")).alias("diff"))
    return diffs.side_by_side(d, ["event_id"])


@register(
    "diff_file_tree",
    r"""WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT string_split(path, '/') AS parts FROM p)
    SELECT array_to_string(parts[1:i], '/') AS folder, i::INTEGER AS depth, count(*)::BIGINT AS files FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM s) GROUP BY ALL""",
)
def diff_file_tree(spark, sf_dir):
    parts = F.split(F.regexp_replace("url", F.lit("^[a-z]+://"), F.lit("")), "/")
    s = spark.read.parquet(f"{sf_dir}/pages.parquet").select(parts.alias("parts"))
    s = s.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return s.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("folder"), "depth").agg(F.count(F.lit(1)).alias("files"))


@register("diff_sample", "SELECT doc_id AS object_id, sha256((encode(text))[1:CASE WHEN octet_length(encode(text)) <= 262144 THEN 262144 ELSE 65536 END]) AS sample_hash FROM documents")
def diff_sample(spark, sf_dir):
    """What a diff looks at: objects of at most 256 KiB whole, the first 64 KiB of longer ones."""
    head = diffs.sample(B.octets(F.col("text")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("object_id"), B.digest(head).alias("sample_hash"))
