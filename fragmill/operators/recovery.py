"""Restoring objects: what is missing or corrupt comes back from its ring neighbour, the rest is reported.

One plan does it all: status by a join with what is expected, recovery among what passed, one row per object at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rings


def merged(index: str, data: str) -> Column:
    """An aggregate: the pieces of a group in order, as one value.  An object's own bytes, which it has to hold anyway."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.hex(data).alias("d"))))
    return F.unhex(F.array_join(F.transform(pieces, lambda x: x["d"]), ""))


def fragments_recovered(expected: DataFrame, available: DataFrame) -> DataFrame:
    """expected (object_id, frag_idx, n, hash) with state (ok, corrupted, missing), data and source.

    available: object_id, frag_idx, own, next (ring-encoded).  Without an expected hash what is there is accepted.  Only
    fragments that passed give their neighbour's copy away.
    """
    seen = expected.join(available, ["object_id", "frag_idx"], "left")
    state = F.when(F.col("own").isNull(), "missing").when(F.col("hash").isNull() | (F.sha2("own", 256) == F.col("hash")), "ok").otherwise("corrupted")
    seen = seen.withColumn("state", state)
    verified = seen.where("state = 'ok'").select("object_id", "frag_idx", "own", "next")
    return rings.ring_recovered(verified, seen.select("object_id", "frag_idx", "n", "state"))


def objects_recovered(expected: DataFrame, available: DataFrame) -> DataFrame:
    """One row per object: counts of its fragments, status complete or partial, and the content if complete."""
    f = fragments_recovered(expected, available)
    count = lambda c: F.count_if(c).alias
    out = f.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("state") != "missing")("available"),
        count(F.col("state") == "missing")("missing"),
        count(F.col("state") == "corrupted")("corrupted"),
        count(F.col("source") == "neighbour")("recovered"),
        count(F.col("source") == "lost")("lost"),
        merged("frag_idx", "data").alias("_content"),
    )
    return out.select("object_id", "total", "available", "missing", "corrupted", "recovered", F.when(F.col("lost") == 0, "complete").otherwise("partial").alias("status"), F.when(F.col("lost") == 0, F.col("_content")).alias("content"))


def block_offsets(fragments: DataFrame, size: int) -> DataFrame:
    """fragments (object_id, frag_idx, size) with blocks and first_block, their place among all blocks of the object."""
    from pyspark.sql import Window

    w = Window.partitionBy("object_id").orderBy("frag_idx").rowsBetween(Window.unboundedPreceding, -1)
    f = fragments.withColumn("blocks", F.ceil(F.col("size") / size).cast("long"))
    return f.withColumn("first_block", F.coalesce(F.sum("blocks").over(w), F.lit(0)).cast("long"))


def stripped(sealed: DataFrame) -> DataFrame:
    """object_id, frag_idx, data, source of ring-encoded fragments with seals (n, own, next, seal).

    One whose seal holds gives its own data; of a broken one the left neighbour's copy is taken if that one's seal
    holds, else its own data stay, marked broken.
    """
    whole = F.sha2(F.concat("own", "next"), 256) == F.col("seal")
    left = sealed.where(whole).select("object_id", F.pmod(F.col("frag_idx") + 1, "n").cast("int").alias("frag_idx"), F.col("next").alias("_copy"))
    rows = sealed.withColumn("_whole", whole).join(left, ["object_id", "frag_idx"], "left")
    source = F.when(F.col("_whole"), "own").when(F.col("_copy").isNotNull(), "neighbour").otherwise("broken")
    return rows.select("object_id", "frag_idx", F.when(F.col("_whole"), F.col("own")).otherwise(F.coalesce("_copy", "own")).alias("data"), source.alias("source"))


def framed(own: Column, one: Column, two: Column) -> Column:
    """Three parts, each behind its length in four little-endian bytes."""
    length = lambda c: F.unhex(F.regexp_replace(F.lpad(F.hex(F.octet_length(c).cast("long")), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    return F.concat(*(x for c in (own, one, two) for x in (length(c), c)))


def parts_of(frame: Column) -> Column:
    """own, one and two of a frame, null for what is no frame: lengths have to add up to all of it."""
    number = lambda at: F.conv(F.regexp_replace(F.hex(F.substr(frame, at, F.lit(4))), "(..)(..)(..)(..)", "$4$3$2$1"), 16, 10).cast("long")
    a = number(F.lit(1))
    b = number((F.lit(5) + a).cast("int"))
    c = number((F.lit(9) + a + b).cast("int"))
    part = lambda at, n: F.substr(frame, at.cast("int"), n.cast("int"))
    return F.when(F.octet_length(frame) == F.lit(12) + a + b + c, F.struct(part(F.lit(5), a).alias("own"), part(F.lit(9) + a, b).alias("one"), part(F.lit(13) + a + b, c).alias("two")))


def frames_recovered(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (object_id, frag_idx, n) with `data` and `round`: 0 where its frame is stored, else the round it came in.

    A missing fragment comes from the frames one and two steps back.  A frame can be made anew once its three parts are
    known, and then gives what it holds, which is known by then: rounds go on until nothing new comes.
    """
    s1, s2 = rings.steps(F.col("n"))
    opened = frames.select("object_id", "frag_idx", parts_of(F.col("frame")).alias("p")).where("p is not null").select("object_id", "frag_idx", "p.*")
    rows = expected.join(opened.select("object_id", "frag_idx", F.col("own").alias("data")), ["object_id", "frag_idx"], "left")
    held = opened.join(expected.select("object_id", "frag_idx", "n"), ["object_id", "frag_idx"])
    at = lambda s, name: held.select("object_id", F.pmod(F.col("frag_idx") + s, F.col("n")).cast("int").alias("frag_idx"), F.col(name).alias(f"_{name}"))
    rows = rows.join(at(s1, "one"), ["object_id", "frag_idx"], "left").join(at(s2, "two"), ["object_id", "frag_idx"], "left")
    found = F.coalesce("data", "_one", "_two")
    return rows.select(*expected.columns, found.alias("data"), F.when(F.col("data").isNotNull(), 0).when(found.isNotNull(), 1).cast("int").alias("round"))


def copies_decoded(copies: DataFrame) -> DataFrame:
    """object_id, block_idx, copies, valid, data of replicated blocks (frag_idx, data, mark): the first whole copy counts."""
    whole = F.left(F.sha2("data", 256), F.lit(16)) == F.col("mark")
    return copies.withColumn("_ok", whole).groupBy("object_id", "block_idx").agg(F.count(F.lit(1)).alias("copies"), F.count_if("_ok").alias("valid"), F.min_by(F.when(F.col("_ok"), F.col("data")), F.when(F.col("_ok"), F.col("frag_idx"))).alias("data"))
