"""Differences between two versions: lines, INI keys, JSON paths, sizes, and which kind of diff applies."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no (from 1), line: without a byte order mark, line ends normalised."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), F.lit("^﻿"), F.lit("")), F.lit("\r\n?"), F.lit("\n"))
    return texts.select(*keys, F.posexplode(F.split(clean, F.lit("\n"), -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def matched_lines(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, type (Context, Addition, Deletion), line, old_no, new_no: the k-th of equal old lines meets the k-th new one."""
    w = Window.partitionBy(*keys, "line").orderBy("line_no")
    a = old.withColumn("k", F.row_number().over(w)).withColumnRenamed("line_no", "old_no")
    b = new.withColumn("k", F.row_number().over(w)).withColumnRenamed("line_no", "new_no")
    out = a.join(b, [*keys, "line", "k"], "full")
    kind = F.when(F.col("new_no").isNull(), "Deletion").when(F.col("old_no").isNull(), "Addition").otherwise("Context")
    return out.select(*keys, kind.alias("type"), "line", "old_no", "new_no")


def line_counters(matched: DataFrame, keys: list[str]) -> DataFrame:
    added, removed = F.count_if(F.col("type") == "Addition"), F.count_if(F.col("type") == "Deletion")
    return matched.groupBy(*keys).agg(added.alias("added_lines"), removed.alias("removed_lines"), F.greatest(added, removed).alias("changed_lines"), F.count_if(F.col("type") == "Context").alias("kept_lines"))


def sample(data: Column, whole: int = 256 * 1024, head: int = 64 * 1024) -> Column:
    """What a diff looks at: an object of at most `whole` bytes in full, of a longer one the first `head` bytes."""
    return F.when(F.octet_length(data) <= whole, data).otherwise(F.substring(data, 1, head))


def common_ends(old: Column, new: Column) -> tuple[Column, Column]:
    """Lines that two arrays share at the start, and at the end of what is left."""
    least = F.least(F.size(old), F.size(new))

    def run(a: Column, b: Column, most: Column) -> Column:
        first_off = F.array_position(F.transform(F.arrays_zip(F.slice(a, 1, most).alias("a"), F.slice(b, 1, most).alias("b")), lambda x: x["a"] == x["b"]), F.lit(False))
        return F.when(most <= 0, F.lit(0)).when(first_off == 0, most).otherwise(first_off - 1).cast("int")

    prefix = run(old, new, least)
    return prefix, run(F.reverse(old), F.reverse(new), least - prefix)


def key_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, change (added, removed, changed), old and new values; equal ones are left out."""
    a, b = old.select(*keys, F.col(value).alias("old"), F.lit(1).alias("_a")), new.select(*keys, F.col(value).alias("new"), F.lit(1).alias("_b"))
    out = a.join(b, keys, "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return out.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(*keys, kind.alias("change"), "old", "new")


def ini_entries(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, section, key, value: sections carry on to the lines below, names in lower case, the last of equal keys counts."""
    rows = lines(texts, keys, text).withColumn("line", F.trim("line"))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower(F.regexp_extract("line", r"^\[\s*(.*?)\s*\]$", 1))), ignorenulls=True).over(w), F.lit("")))
    pairs = named.where(F.col("line").rlike(r"^[^;#\[=][^=]*=")).select(*keys, "section", F.lower(F.trim(F.regexp_extract("line", r"^([^=]*)=", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("value"), "line_no")
    return pairs.groupBy(*keys, "section", "key").agg(F.max_by("value", "line_no").alias("value"))


def json_entries(texts: DataFrame, keys: list[str], text: str = "text", depth: int | None = None) -> DataFrame:
    """keys, path, value: the leaves of JSON documents, as `$.a.b[0]`, at any depth.

    A level of the plan for each level of the deepest document, which costs a look for what is left; `depth` spares
    these looks and leaves deeper parts as JSON.
    """
    now = texts.select(*keys, F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("v")).where("v is not null")
    done = None
    for level in count():
        if level == depth:
            break
        kind = F.schema_of_variant("v")
        leaf = now.where(~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))).select(*keys, "path", F.to_json("v").alias("value"))
        done = leaf if done is None else done.unionByName(leaf)
        parents = now.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if depth is None and parents.isEmpty():
            return done
        inner = F.try_variant_get("v", F.lit("$"), "map<string,variant>")
        items = F.try_variant_get("v", F.lit("$"), "array<variant>")
        fields = F.transform(F.map_entries(inner), lambda e: F.struct(F.concat("path", F.lit("."), e["key"]).alias("path"), e["value"].alias("v")))
        places = F.transform(items, lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")))
        now = parents.select(*keys, F.explode(F.when(kind.startswith("OBJECT"), fields).otherwise(places)).alias("x")).select(*keys, "x.path", "x.v")
    rest = now.select(*keys, "path", F.to_json("v").alias("value"))
    return rest if done is None else done.unionByName(rest)


# Extensions and scores of the strategies, in order of preference at equal score.
STRATEGIES = ("json", "ini", "image", "media", "text", "binary")
_IMAGES, _MEDIA = "png|jpg|jpeg|gif|bmp|webp|tiff", "mp3|flac|ogg|wav|m4a|mp4"
_TEXT = "txt|md|html|htm|css|js|xml|csv|log|py|cs|yaml|yml"


def strategy(extension: Column, head: Column) -> tuple[Column, Column]:
    """The best strategy for a file and its score; the first of equals wins."""
    scores = (
        F.when(extension == "json", 1.0).when(head.rlike(r"^\s*[\{\[]") & ~head.rlike(r"^\s*\[[^\n]*\]\s*(\n|$)"), 0.95).otherwise(0.0),
        F.when(extension.isin("ini", "cfg", "conf"), 1.0).when(head.rlike(r"^\s*\[[^\n]*\]\s*(\n|$)"), 0.8).otherwise(0.0),
        F.when(extension.rlike(f"^({_IMAGES})$"), 1.0).otherwise(0.0),
        F.when(extension.rlike(f"^({_MEDIA})$"), 1.0).otherwise(0.0),
        F.when(extension.rlike(f"^({_TEXT})$"), 1.0).when(~head.rlike(r"[\x00-\x08\x0E-\x1F]"), 0.9).otherwise(0.0),
        F.lit(0.01),
    )
    best = F.greatest(*scores)
    name = F.lit(STRATEGIES[-1])
    for n, s in reversed(list(zip(STRATEGIES, scores))):
        name = F.when(s == best, n).otherwise(name)
    return name, best


def size_change(old: Column, new: Column) -> list[Column]:
    """Bytes added and removed, and the change as a share of the old size."""
    delta = new - old
    return [F.greatest(delta, F.lit(0)).alias("added_bytes"), F.greatest(-delta, F.lit(0)).alias("removed_bytes"), F.when(old > 0, F.abs(delta) / old).otherwise(0.0).alias("change_ratio")]


def side_by_side(diffs: DataFrame, keys: list[str], text: str = "diff") -> DataFrame:
    """keys, row, left_no, left, right_no, right of unified diff text: numbers run on from each hunk's header."""
    rows = diffs.select(*keys, F.posexplode(F.split(text, "\n")).alias("row", "line"))
    w = Window.partitionBy(*keys).orderBy("row")
    head = F.col("line").rlike(r"^@@ -\d+ \+\d+ @@")
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("hunk", F.sum(head.cast("int")).over(seen))
    h = Window.partitionBy(*keys, "hunk").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "hunk")
    first = lambda n: F.max(F.when(head, F.regexp_extract("line", r"^@@ -(\d+) \+(\d+) @@", n).cast("int"))).over(whole)
    on_left, on_right = ~head & ~F.col("line").startswith("+"), ~head & ~F.col("line").startswith("-")
    return rows.select(
        *keys,
        "row",
        F.when(on_left, first(1) + F.sum(on_left.cast("int")).over(h) - 1).alias("left_no"),
        F.when(on_left, F.substr("line", F.lit(2), F.length("line"))).alias("left"),
        F.when(on_right, first(2) + F.sum(on_right.cast("int")).over(h) - 1).alias("right_no"),
        F.when(on_right, F.substr("line", F.lit(2), F.length("line"))).alias("right"),
    )
