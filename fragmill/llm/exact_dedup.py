"""Exact duplicates by content sort (DataFrame functions only).

Rows are range-partitioned by Spark's sampled splitters over the first letters of the normalised text, then its 64-bit
mark, and sorted externally by the whole normalised text, so equal texts stand next to each other.  A window compares
each row in full with its neighbour: a run of equal neighbours is a group, and its first row (most code points, then
smallest doc_id) is the one that stays.

A text that more than one row in `RUNS` holds would fill a range by itself.  Its mark is counted beforehand, in partial
aggregation, and its rows are dealt by a salt in the sort key, so it makes several runs of bounded size.  One row of each
such run is compared in full with those of the other runs; there are at most 2 * `RUNS` of these rows, however large the
table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_of, text_or_empty, written

#: A text is dealt into several runs if more than one row in so many has it.
RUNS = 512
#: Code points that splitters compare, so that the sampled splitters stay small; the sort compares whole texts.
HEAD = 48

_FIRST = (F.desc, "points"), (F.asc_nulls_last, "id")


def normalised(text: Column) -> Column:
    """The text without the characters of [ \\t\\n\\v\\f\\r]."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def _keyed(docs: DataFrame, payload: Column) -> DataFrame:
    """payload, id, points (code points), and what splitters compare: head and mark."""
    text = text_or_empty(docs)
    norm = normalised(text)
    return docs.select(payload.alias("payload"), docs["doc_id"].alias("id"), F.char_length(text).alias("points"), F.left(norm, F.lit(HEAD)).alias("head"), F.xxhash64(norm).alias("mark"))


def _hot(docs: DataFrame, runs: int) -> DataFrame:
    """mark, salts: the texts that get several runs, fewer than `runs`, and salts at most twice as many in all."""
    norm = normalised(text_or_empty(docs))
    rows = docs.count()
    counted = docs.groupBy(F.xxhash64(norm).alias("mark")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return written(counted.where(F.col("n") * runs > rows).select("mark", F.ceil(F.col("n") * runs / max(1, rows)).cast("int").alias("salts")), "exact-hot")


def _sorted(keyed: DataFrame, hot: DataFrame, norm: Column) -> DataFrame:
    """The rows in content order with place, size and run: place among the equal neighbours of a run, their number."""
    salted = keyed.join(F.broadcast(hot), "mark", "left")  # fewer than RUNS rows
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "points"), F.col("salts")), F.lit(0)))
    ranged = salted.repartitionByRange("head", "mark", "salt").withColumn("norm", norm).withColumn("at", F.monotonically_increasing_id())
    equal = Window.partitionBy("head", "mark", "salt", "norm").orderBy(*(f(c) for f, c in _FIRST))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.select(
        "payload", "id", "points", "head", "mark", "salt", "norm", F.col("salts").isNotNull().alias("salted"),
        F.row_number().over(equal).alias("place"), F.count(F.lit(1)).over(whole).alias("size"), F.first("id").over(whole).alias("first_id"), F.first("at").over(whole).alias("run"),
    )


def _merged(heads: DataFrame) -> DataFrame:
    """The first rows of a hot text's runs, compared in full: run, size and id of the whole group, and whether it stays."""
    whole = Window.partitionBy("norm").orderBy(*(f(c) for f, c in _FIRST), "run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return heads.select("head", "mark", "salt", "points", "id", "run", F.sum("size").over(whole).alias("all"), F.first("id").over(whole).alias("keep"), (F.first("run").over(whole) == F.col("run")).alias("stays"))


def exact_groups(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; of equal ones the row with most
    code points, then the smallest doc_id stays.  Null text counts as empty.  Rows that repeat an id and a text count
    in group_size; `kept` holds for one of them only.  A null id stays only if all ids of its longest rows are null.
    Texts of any length are compared whole; one row has to fit into a task's memory.  An empty table gives an empty one;
    other columns are not looked at, so their names may be any.
    """
    rows = _sorted(_keyed(docs, F.struct(normalised(text_or_empty(docs)).alias("norm"))), _hot(docs, runs), F.col("payload.norm"))
    first = F.col("salted") & (F.col("place") == 1)
    found = written(rows.select("id", "points", "head", "mark", "salt", "place", "size", "first_id", "run", F.sha2("norm", 256).alias("sha"), F.when(first, F.col("norm")).alias("norm")), "exact-runs")
    merged = written(_merged(found.where("norm is not null")).select("run", "all", "keep", "stays"), "exact-merged")
    whole = found.join(F.broadcast(merged), "run", "left")  # at most 2 * RUNS rows
    return whole.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("all").isNull(), F.col("first_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("all", "size").alias("group_size"),
        ((F.col("place") == 1) & F.coalesce("stays", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns, whatever their names.

    Rows travel once, through the sort, which drops what repeats a neighbour.  Of a hot text the runs are compared
    beforehand, on its own rows alone, and what loses there goes too: at most 2 * `RUNS` rows.
    """
    hot = _hot(docs, runs)
    losers = None
    if not hot.isEmpty():
        slim = _keyed(docs, F.struct(normalised(text_or_empty(docs)).alias("norm"))).join(F.broadcast(hot.select("mark")), "mark", "left_semi")
        heads = written(_sorted(slim, hot, F.col("payload.norm")).where("place = 1").drop("payload"), "exact-heads")
        losers = written(_merged(heads).where("not stays").select(*(F.col(c).alias(f"lost_{c}") for c in ("head", "mark", "salt", "points", "id"))), "exact-losers")
    rows = _sorted(_keyed(docs, row_of(docs)), hot, normalised(F.coalesce(F.col("payload.text").cast("string"), F.lit("")))).where("place = 1")
    if losers is not None:
        same = [F.col(c).eqNullSafe(F.col(f"lost_{c}")) for c in ("head", "mark", "salt", "points", "id")]
        rows = rows.join(F.broadcast(losers), same, "left_anti")  # at most 2 * RUNS rows
    return rows.select("payload.*")
