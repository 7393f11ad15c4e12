"""Queries over restores: whole plans from damage to content, two-dimensional parity, seals, frames, rebuilt blocks."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import fountain
from ..operators import chunking, parity, recovery, rings
from .catalog import register
from .chunk_queries import OBJECTS, blocks_sql, objects
from .code_queries import _N, _STEP, fragments

_THERE, _WHOLE = "(object_id + frag_idx) % 11 <> 3", "(object_id * 31 + frag_idx * 7) % 97 <> 13"


@register(
    "recover_objects",
    f"""WITH {_N}, s AS (SELECT *, {_THERE} AS there, {_THERE} AND {_WHOLE} AS good FROM f),
    r AS (SELECT s.*, l.good AS kept FROM s JOIN s l ON l.object_id = s.object_id AND l.frag_idx = (s.frag_idx + s.n - 1) % s.n)
    SELECT object_id, count(*)::BIGINT AS total, count_if(there)::BIGINT AS available, count_if(NOT there)::BIGINT AS missing, count_if(there AND NOT good)::BIGINT AS corrupted,
           count_if(NOT good AND kept)::BIGINT AS recovered, CASE WHEN bool_and(good OR kept) THEN 'complete' ELSE 'partial' END AS status, CASE WHEN bool_and(good OR kept) THEN sha256(any_value(o.content)) END AS hash
    FROM r JOIN objects o USING (object_id) GROUP BY object_id""",
)
def recover_objects(spark, sf_dir):
    """Fragments are missing and corrupt at once; one plan tells, recovers, merges and reports."""
    f = fragments(spark, sf_dir)
    expected = f.select("object_id", "frag_idx", "n", B.digest(F.col("data")).alias("hash"))
    stored = rings.ring_encoded(f).where(_THERE).select("object_id", "frag_idx", F.when(F.expr(_WHOLE), F.col("own")).otherwise(F.concat("own", F.lit(b"X"))).alias("own"), "next")
    return recovery.objects_recovered(expected, stored).withColumn("hash", B.digest(F.col("content"))).drop("content")


@register(
    "block_offsets",
    f"""WITH {OBJECTS}, {blocks_sql(1000, 'f', 'frag_idx')}, b AS (SELECT object_id, frag_idx, (octet_length(data) + 255) // 256 AS blocks FROM f)
    SELECT object_id, frag_idx::INTEGER AS frag_idx, blocks::BIGINT AS blocks, coalesce(sum(blocks) OVER (PARTITION BY object_id ORDER BY frag_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_block FROM b""",
)
def block_offsets(spark, sf_dir):
    f = chunking.split(objects(spark, sf_dir), 1000).select("object_id", "frag_idx", "size")
    return recovery.block_offsets(f, 256).select("object_id", "frag_idx", "blocks", "first_block")


def _cut(content: bytes, size: int) -> list[bytes]:
    return [content[i : i + size] for i in range(0, len(content), size)]


@register(
    "grid_recover",
    f"WITH {OBJECTS} SELECT object_id, (object_id % ((n + 1023) // 1024))::INTEGER AS lost, sha256(content[(object_id % ((n + 1023) // 1024)) * 1024 + 1 : (object_id % ((n + 1023) // 1024)) * 1024 + 1024]) AS hash FROM objects WHERE n > 0",
)
def grid_recover(spark, sf_dir):
    """One fragment of each object is lost and comes back from the check row of its two-dimensional code."""

    def run(content, object_id):
        data = _cut(content, 1024)
        lost = object_id % len(data)
        stored = {i: x for i, x in enumerate(parity.grid_encoded(data)) if i != lost}
        return lost, hashlib.sha256(parity.grid_decoded(stored, [lost], [len(x) for x in data])[lost]).hexdigest()

    return parity.per_object(objects(spark, sf_dir).where(F.octet_length("content") > 0), run, "lost int, hash string")


@register(
    "cells_recover",
    f"WITH {OBJECTS}, {blocks_sql(32, 'f', 'frag_idx')} SELECT object_id, count(*)::INTEGER AS lost, sha256(string_agg(sha256(data), '' ORDER BY frag_idx)) AS hash FROM f WHERE (object_id + frag_idx) % 3 = 0 GROUP BY object_id HAVING count(*) > 1",
)
def cells_recover(spark, sf_dir):
    """A third of the fragments, of two cells each, is lost: too many for the check row, but each has its own check cells."""

    def run(content, object_id):
        data = _cut(content, 32)
        lost = [i for i in range(len(data)) if (object_id + i) % 3 == 0]
        if len(lost) < 2:
            return len(lost), None
        stored = {i: x for i, x in enumerate(parity.grid_encoded(data)) if i not in set(lost)}
        back = parity.grid_decoded(stored, lost, [len(x) for x in data])
        return len(lost), hashlib.sha256("".join(hashlib.sha256(back[i]).hexdigest() for i in lost).encode()).hexdigest()

    return parity.per_object(objects(spark, sf_dir).where(F.octet_length("content") > 0), run, "lost int, hash string").where("hash is not null")


@register(
    "strip_sealed",
    f"""WITH {_N}, s AS (SELECT *, {_WHOLE} AS good FROM f)
    SELECT s.object_id, s.frag_idx::INTEGER AS frag_idx, CASE WHEN s.good THEN 'own' WHEN l.good THEN 'neighbour' ELSE 'broken' END AS source, sha256(CASE WHEN s.good OR l.good THEN s.data ELSE s.data || 'X'::BLOB END) AS hash
    FROM s JOIN s l ON l.object_id = s.object_id AND l.frag_idx = (s.frag_idx + s.n - 1) % s.n""",
)
def strip_sealed(spark, sf_dir):
    e = rings.ring_sealed(rings.ring_encoded(fragments(spark, sf_dir))).withColumn("own", F.when(F.expr(_WHOLE), F.col("own")).otherwise(F.concat("own", F.lit(b"X"))))
    return recovery.stripped(e).select("object_id", "frag_idx", "source", B.digest(F.col("data")).alias("hash"))


_LE = "unhex(regexp_replace(lpad(to_hex(octet_length({0})), 8, '0'), '(..)(..)(..)(..)', '\\4\\3\\2\\1'))"


@register(
    "cross_frames",
    f"""WITH {_N} SELECT f.object_id, f.frag_idx::INTEGER AS frag_idx, sha256({_LE.format('f.data')} || f.data || {_LE.format('a.data')} || a.data || {_LE.format('b.data')} || b.data) AS hash FROM f
    JOIN f a ON a.object_id = f.object_id AND a.frag_idx = (f.frag_idx + {_STEP[0]}) % f.n
    JOIN f b ON b.object_id = f.object_id AND b.frag_idx = (f.frag_idx + {_STEP[1]}) % f.n""",
)
def cross_frames(spark, sf_dir):
    e = rings.cross_encoded(fragments(spark, sf_dir))
    return e.select("object_id", "frag_idx", B.digest(recovery.framed(F.col("data"), F.col("one"), F.col("two"))).alias("hash"))


@register(
    "frames_recover",
    f"""WITH {_N}, s AS (SELECT * FROM f WHERE (object_id + frag_idx) % 5 >= 2),
    k AS (SELECT f.object_id, f.frag_idx, bool_or(s.object_id IS NOT NULL) AS kept FROM f LEFT JOIN s ON s.object_id = f.object_id AND (f.frag_idx = (s.frag_idx + {_STEP[0]}) % f.n OR f.frag_idx = (s.frag_idx + {_STEP[1]}) % f.n) GROUP BY ALL)
    SELECT f.object_id, f.frag_idx::INTEGER AS frag_idx, CASE WHEN (f.object_id + f.frag_idx) % 5 >= 2 THEN 0 WHEN kept THEN 1 END::INTEGER AS round,
           CASE WHEN (f.object_id + f.frag_idx) % 5 >= 2 OR kept THEN sha256(data) END AS hash FROM f JOIN k USING (object_id, frag_idx)""",
)
def frames_recover(spark, sf_dir):
    """Two fifths of the frames are lost; parts come out of the frames one and two steps back."""
    f = fragments(spark, sf_dir)
    e = rings.cross_encoded(f)
    frames = e.where("(object_id + frag_idx) % 5 >= 2").select("object_id", "frag_idx", recovery.framed(F.col("data"), F.col("one"), F.col("two")).alias("frame"))
    return recovery.frames_recovered(frames, f.select("object_id", "frag_idx", "n")).select("object_id", "frag_idx", "round", B.digest(F.col("data")).alias("hash"))


@register(
    "replicated_decode",
    f"""WITH {OBJECTS}, {blocks_sql(512)}, c AS (SELECT b.object_id, b.block_idx, a.block_idx AS frag_idx, b.data, (b.object_id + b.block_idx * 3 + a.block_idx) % 4 <> 1 AS good FROM blocks a JOIN blocks b ON a.object_id = b.object_id AND a.object_id % 10 = 0)
    SELECT object_id, block_idx::INTEGER AS block_idx, count(*)::BIGINT AS copies, count_if(good)::BIGINT AS valid, CASE WHEN bool_or(good) THEN sha256(any_value(data)) END AS hash FROM c GROUP BY ALL""",
)
def replicated_decode(spark, sf_dir):
    """A quarter of all copies is damaged; blocks come from the first copy whose digest holds.  Objects of every tenth id."""
    b = chunking.split(objects(spark, sf_dir).where("object_id % 10 = 0"), 512, ordinal="block_idx").select("object_id", "block_idx", "data")
    c = rings.replicated(b).withColumn("data", F.when((F.col("object_id") + F.col("block_idx") * 3 + F.col("frag_idx")) % 4 != 1, F.col("data")).otherwise(F.concat("data", F.lit(b"X"))))
    return recovery.copies_decoded(c).select("object_id", "block_idx", "copies", "valid", B.digest(F.col("data")).alias("hash"))


@register(
    "rebuild_blocks",
    f"""WITH {OBJECTS}, {blocks_sql(1000, 'f', 'frag_idx')}, b AS (SELECT object_id, frag_idx, unnest(range(0, (octet_length(data) + 255) // 256)) AS k FROM f)
    SELECT object_id, count(*)::INTEGER AS blocks, count_if((object_id * 31 + frag_idx * 7 + k * 13) % 97 < 2)::INTEGER AS bad, true AS counted FROM b GROUP BY object_id""",
)
def rebuild_blocks(spark, sf_dir):
    """Bad blocks of all fragments in a row, rebuilt from both codes' symbols; whether the count of blocks matched."""

    def run(content, object_id):
        data, bad = _cut(content, 1000), {}
        for i, x in enumerate(data):
            bad[i] = {k for k in range(-(-len(x) // 256)) if (object_id * 31 + i * 7 + k * 13) % 97 < 2}
        blocks = sum(-(-len(x) // 256) for x in data)
        rows = np.concatenate([parity.matrix(x, 256) for x in data])
        whole = True
        for code, equations in (("lt", fountain.lt_equations), ("duip", fountain.duip_equations)):
            symbols = fountain.symbols(rows, equations(blocks))
            broken = [bytes(b ^ (255 if j // 256 in bad[i] else 0) for j, b in enumerate(x)) for i, x in enumerate(data)]
            back = parity.rebuilt(broken, 256, code, bad, symbols, blocks)
            whole &= back is not None and parity.rebuilt(broken, 256, code, bad, symbols, blocks + 1) is None
            # what was good stays so, and what came back is the original's
            whole &= all(y[k * 256 : k * 256 + 256] in (x[k * 256 : k * 256 + 256], z[k * 256 : k * 256 + 256]) for x, y, z in zip(data, back, broken) for k in range(-(-len(x) // 256)))
        return blocks, sum(map(len, bad.values())), bool(whole)

    return parity.per_object(objects(spark, sf_dir).where(F.octet_length("content") > 0), run, "blocks int, bad int, counted boolean")


@register(
    "node_repair",
    f"""WITH {OBJECTS}, a AS (SELECT object_id, 'A' AS scope, 64 + octet_length(encode(object_id::VARCHAR)) AS size FROM objects UNION ALL SELECT object_id, 'B', 64 * ((n + 1023) // 1024) FROM objects UNION ALL SELECT object_id, 'C', n FROM objects),
    k AS (SELECT object_id, scope, (size + 31) // 32 AS blocks FROM a WHERE size > 0)
    SELECT object_id, scope, blocks::INTEGER AS blocks, greatest(1, floor(blocks * 0.7::DOUBLE))::INTEGER AS lt_symbols, greatest(1, floor(blocks * 0.6::DOUBLE))::INTEGER AS duip_symbols, true AS repaired FROM k""",
)
def node_repair(spark, sf_dir):
    """Repair symbols of all three nodes: index, container, fragments.  A block of each is lost and comes back.

    The second code's last symbol adds up all blocks, so one lost block always comes back.
    """

    def run(content, object_id):
        digests = [hashlib.sha256(x).hexdigest().encode() for x in _cut(content, 1024)]
        out = []
        for scope, data in (("A", hashlib.sha256(content).hexdigest().encode() + str(object_id).encode()), ("B", b"".join(digests)), ("C", content)):
            if not data:
                continue
            blocks = -(-len(data) // 32)
            symbols = fountain.symbols(parity.matrix(data, 32), fountain.duip_equations(blocks))
            lost = object_id % blocks
            broken = data[: 32 * lost] + bytes(len(data[32 * lost : 32 * lost + 32])) + data[32 * lost + 32 :]
            back = parity.rebuilt([broken], 32, "duip", {0: {lost}}, symbols, blocks)
            out.append({"scope": scope, "blocks": blocks, "lt_symbols": len(fountain.lt_members(blocks)), "duip_symbols": len(symbols), "repaired": back == [data]})
        return (out,)

    nodes = parity.per_object(objects(spark, sf_dir), run, "nodes array<struct<scope:string,blocks:int,lt_symbols:int,duip_symbols:int,repaired:boolean>>")
    return nodes.select("object_id", F.explode("nodes").alias("x")).select("object_id", "x.*")


@register("face_entropy")
def face_entropy(spark, sf_dir):
    """The entropy byte of every face of 32 blocks."""

    def run(content, _):
        return ([{"face": i, "entropy": x} for i, x in enumerate(fountain.face_entropy(parity.matrix(content, 64)))],)

    f = parity.per_object(objects(spark, sf_dir).where(F.octet_length("content") > 0), run, "faces array<struct<face:int,entropy:int>>")
    return f.select("object_id", F.explode("faces").alias("x")).select("object_id", "x.*")


@register(
    "symbol_coverage",
    f"""WITH {OBJECTS}, k AS (SELECT DISTINCT (n + 255) // 256 AS blocks FROM objects WHERE n > 0), e AS (SELECT blocks, greatest(1, floor(blocks * 0.6::DOUBLE))::BIGINT AS symbols FROM k)
    SELECT blocks::INTEGER AS blocks, symbols::INTEGER AS symbols, ((blocks + 31) // 32)::INTEGER AS faces, true AS covered FROM e""",
)
def symbol_coverage(spark, sf_dir):
    """For every number of blocks that occurs: symbols, faces, and whether the symbols cover all blocks and add up."""
    kinds = objects(spark, sf_dir).select(F.ceil(F.octet_length("content") / 256).cast("int").alias("blocks")).where("blocks > 0").distinct()

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for k in map(int, b["blocks"]):
                members = fountain.duip_members(k)
                columns, faces = fountain.coverage(members, k)
                rows.append((k, len(members), len(faces), bool((columns > 0).all() and faces.sum() == len(members) and columns.sum() == sum(map(len, members)))))
            yield pd.DataFrame(rows, columns=["blocks", "symbols", "faces", "covered"]).astype({"blocks": "int32", "symbols": "int32", "faces": "int32"})

    return kinds.mapInPandas(run, "blocks int, symbols int, faces int, covered boolean")


@register(
    "padded_blocks",
    f"""WITH {OBJECTS}, {blocks_sql(256)} SELECT object_id, block_idx::INTEGER AS block_idx, 256 AS size, sha256(unhex(rpad(hex(data), 512, '0'))) AS hash FROM blocks""",
)
def padded_blocks(spark, sf_dir):
    """Blocks filled up with zeros, as symbols are made of them."""
    b = chunking.split(objects(spark, sf_dir), 256, ordinal="block_idx").select("object_id", "block_idx", chunking.padded(F.col("data"), 256).alias("data"))
    return b.select("object_id", "block_idx", F.octet_length("data").alias("size"), B.digest(F.col("data")).alias("hash"))


@register(
    "trimmed_merge",
    f"WITH {OBJECTS} SELECT object_id, n::INTEGER AS size, sha256(content) AS hash FROM objects WHERE n > 0",
)
def trimmed_merge(spark, sf_dir):
    """Padded blocks put together again and cut to the object's length."""
    o = objects(spark, sf_dir).withColumn("length", F.octet_length("content"))
    b = chunking.split(o, 256, ordinal="block_idx", keep=("object_id", "length")).withColumn("data", chunking.padded(F.col("data"), 256))
    m = chunking.merged(b, ["object_id"], ordinal="block_idx", trim="length")
    return m.select("object_id", F.octet_length("content").alias("size"), B.digest(F.col("content")).alias("hash"))


@register(
    "first_shards",
    f"""WITH {_N}, a AS (SELECT object_id, frag_idx, n, row_number() OVER (PARTITION BY object_id ORDER BY frag_idx) AS k FROM f WHERE {_THERE}) SELECT object_id, frag_idx::INTEGER AS frag_idx, k::INTEGER AS place FROM a WHERE k <= (n + 1) // 2""",
)
def first_shards(spark, sf_dir):
    """Of the fragments that are there the first ones that decoding takes: half of all, rounded up."""
    from pyspark.sql import Window

    f = fragments(spark, sf_dir).where(_THERE).select("object_id", "frag_idx", "n")
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("object_id").orderBy("frag_idx")))
    return f.where(F.col("place") <= F.floor((F.col("n") + 1) / 2)).select("object_id", "frag_idx", "place")
