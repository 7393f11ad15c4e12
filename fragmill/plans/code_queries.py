"""Queries over neighbour rings, parity and fountain codes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import fountain, galois
from ..operators import chunking, parity, rings
from .catalog import register
from .chunk_queries import OBJECTS, blocks_sql, objects

_N = f"{OBJECTS}, {blocks_sql(1024, 'f0', 'frag_idx')}, f AS (SELECT *, count(*) OVER (PARTITION BY object_id) AS n FROM f0)"


def fragments(spark, sf_dir, size=1024):
    o = objects(spark, sf_dir)
    f = chunking.split(o.withColumn("n", F.ceil(F.octet_length("content") / size).cast("int")), size, keep=("object_id", "n"))
    return f.select("object_id", "frag_idx", "n", "data")


@register(
    "ring_encode",
    f"""WITH {_N}, e AS (SELECT object_id, frag_idx, data || coalesce(lead(data) OVER w, first_value(data) OVER w) AS pair FROM f WINDOW w AS (PARTITION BY object_id ORDER BY frag_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT object_id, frag_idx::INTEGER AS frag_idx, octet_length(pair)::INTEGER AS size, sha256(pair) AS seal FROM e""",
)
def ring_encode(spark, sf_dir):
    e = rings.ring_sealed(rings.ring_encoded(fragments(spark, sf_dir)))
    return e.select("object_id", "frag_idx", (F.octet_length("own") + F.octet_length("next")).alias("size"), "seal")


@register(
    "ring_recover",
    f"""WITH {_N}, s AS (SELECT * FROM f WHERE (object_id + frag_idx) % 11 <> 3)
    SELECT f.object_id, f.frag_idx::INTEGER AS frag_idx,
           CASE WHEN (f.object_id + f.frag_idx) % 11 <> 3 THEN 'stored' WHEN l.object_id IS NOT NULL THEN 'neighbour' ELSE 'lost' END AS source,
           CASE WHEN (f.object_id + f.frag_idx) % 11 <> 3 OR l.object_id IS NOT NULL THEN sha256(f.data) END AS hash
    FROM f LEFT JOIN s l ON l.object_id = f.object_id AND l.frag_idx = (f.frag_idx + f.n - 1) % f.n""",
)
def ring_recover(spark, sf_dir):
    f = fragments(spark, sf_dir)
    stored = rings.ring_encoded(f).where("(object_id + frag_idx) % 11 <> 3")
    out = rings.ring_recovered(stored, f.select("object_id", "frag_idx", "n"))
    return out.select("object_id", "frag_idx", "source", B.digest(F.col("data")).alias("hash"))


@register(
    "ring_verify",
    f"""WITH {_N} SELECT object_id, count(*)::BIGINT AS fragments, count_if((object_id * 31 + frag_idx * 7) % 97 = 13)::BIGINT AS broken FROM f GROUP BY object_id""",
)
def ring_verify(spark, sf_dir):
    """Seals are checked after deterministic damage."""
    e = rings.ring_sealed(rings.ring_encoded(fragments(spark, sf_dir)))
    bad = (F.col("object_id") * 31 + F.col("frag_idx") * 7) % 97 == 13
    own = F.when(bad, F.concat("own", F.lit(b"X"))).otherwise(F.col("own"))
    return e.groupBy("object_id").agg(F.count(F.lit(1)).alias("fragments"), F.count_if(rings.seal_broken(own, F.col("next"), F.col("seal"))).alias("broken"))


_STEP = "CASE WHEN f.n <= 8 THEN 1 WHEN f.n <= 16 THEN 2 ELSE 3 END", "CASE WHEN f.n <= 4 THEN 2 WHEN f.n <= 8 THEN 3 WHEN f.n <= 16 THEN 5 ELSE 7 END"


@register(
    "cross_encode",
    f"""WITH {_N} SELECT f.object_id, f.frag_idx::INTEGER AS frag_idx, sha256(f.data || a.data || b.data) AS seal FROM f
    JOIN f a ON a.object_id = f.object_id AND a.frag_idx = (f.frag_idx + {_STEP[0]}) % f.n
    JOIN f b ON b.object_id = f.object_id AND b.frag_idx = (f.frag_idx + {_STEP[1]}) % f.n""",
)
def cross_encode(spark, sf_dir):
    e = rings.cross_encoded(fragments(spark, sf_dir))
    return e.select("object_id", "frag_idx", B.digest(F.concat("data", "one", "two")).alias("seal"))


@register(
    "cross_recover",
    f"""WITH {_N}, s AS (SELECT * FROM f WHERE (object_id + frag_idx) % 5 >= 2),
    k AS (SELECT f.object_id, f.frag_idx, bool_or(s.object_id IS NOT NULL) AS kept FROM f LEFT JOIN s ON s.object_id = f.object_id AND (f.frag_idx = (s.frag_idx + {_STEP[0]}) % f.n OR f.frag_idx = (s.frag_idx + {_STEP[1]}) % f.n) GROUP BY ALL)
    SELECT f.object_id, f.frag_idx::INTEGER AS frag_idx, CASE WHEN (f.object_id + f.frag_idx) % 5 >= 2 THEN 'stored' WHEN kept THEN 'kept' ELSE 'lost' END AS source,
           CASE WHEN (f.object_id + f.frag_idx) % 5 >= 2 OR kept THEN sha256(data) END AS hash FROM f JOIN k USING (object_id, frag_idx)""",
)
def cross_recover(spark, sf_dir):
    f = fragments(spark, sf_dir)
    stored = rings.cross_encoded(f).where("(object_id + frag_idx) % 5 >= 2")
    out = rings.cross_recovered(stored, f.select("object_id", "frag_idx", "n"))
    return out.select("object_id", "frag_idx", "source", B.digest(F.col("data")).alias("hash"))


_WORDS = f"""{OBJECTS}, {blocks_sql(256)}, p AS (SELECT object_id, block_idx, rpad(hex(data), ((octet_length(data) + 3) // 4 * 8)::INTEGER, '0') AS x, (octet_length(data) + 3) // 4 AS m FROM blocks),
    w AS (SELECT object_id, block_idx, j AS word, ('0x' || x[j * 8 + 1 : j * 8 + 8])::BIGINT AS value FROM (SELECT *, unnest(range(0, m)) AS j FROM p))"""


@register("xor_parity", f"WITH {_WORDS} SELECT object_id, word::INTEGER AS word, bit_xor(value)::BIGINT AS parity FROM w GROUP BY object_id, word")
def xor_parity(spark, sf_dir):
    """Sums of all blocks, in the object's own row: nothing but the sum leaves it."""
    sums = parity.per_object(objects(spark, sf_dir), lambda content, _: (parity.xor_row(content, 256),), "words array<long>")
    return sums.select("object_id", F.posexplode("words").alias("word", "parity"))


@register(
    "ladder_precode",
    f"""WITH {_WORDS} SELECT object_id, block_idx::INTEGER AS block_idx, word::INTEGER AS word, xor(value, lead(value) OVER (PARTITION BY object_id, word ORDER BY block_idx))::BIGINT AS step FROM w
    QUALIFY lead(value) OVER (PARTITION BY object_id, word ORDER BY block_idx) IS NOT NULL""",
)
def ladder_precode(spark, sf_dir):
    """Each block with the next; a step joins one word position, so windows stay one object's blocks wide."""
    b = chunking.split(objects(spark, sf_dir), 256, ordinal="block_idx")
    w = b.select("object_id", "block_idx", F.explode(B.words32(F.col("data"))).alias("w")).select("object_id", "block_idx", "w.word", "w.value")
    after = w.select("object_id", (F.col("block_idx") - 1).alias("block_idx"), "word", F.col("value").alias("next"))
    return w.join(after, ["object_id", "block_idx", "word"]).select("object_id", "block_idx", "word", F.col("value").bitwiseXOR(F.col("next")).alias("step"))


_EXP, _LOG = [int(x) for x in galois.EXP[:255]], [int(x) for x in galois.LOG]
_BYTES = "x AS (SELECT object_id, frag_idx, j, ('0x' || hex(data[j + 1 : j + 1]))::INTEGER AS v FROM (SELECT *, unnest(range(0, octet_length(data))) AS j FROM f0))"
_GF = f"CASE WHEN v = 0 THEN 0 ELSE ({_EXP}::INTEGER[])[(({_LOG}::INTEGER[])[v + 1] + {{c}}) % 255 + 1] END"


@register(
    "row_parity",
    f"""WITH {OBJECTS}, {blocks_sql(256, 'f0', 'frag_idx')}, {_BYTES}, p AS (SELECT object_id, j, bit_xor({_GF.format(c='frag_idx % 255')})::BIGINT AS b FROM x GROUP BY object_id, j)
    SELECT object_id, sum(b * (j + 1))::BIGINT AS checksum, sum(b)::BIGINT AS total FROM p GROUP BY object_id""",
)
def row_parity(spark, sf_dir):
    """One Reed-Solomon row over an object's pieces, told by weighted sums of its bytes."""

    def run(content, _):
        p = parity.row_parity(content, 256).astype(np.int64)
        return int((p * np.arange(1, len(p) + 1)).sum()), int(p.sum())

    return parity.per_object(objects(spark, sf_dir).where(F.octet_length("content") > 0), run, "checksum long, total long")  # an empty object has no row to add up


@register(
    "column_parity",
    f"""WITH {OBJECTS}, {blocks_sql(1024, 'f0', 'frag_idx')}, {_BYTES},
    p AS (SELECT object_id, frag_idx, j % 16 AS c, bit_xor({_GF.format(c='(j // 16) % 255')})::BIGINT AS b1, bit_xor({_GF.format(c='(2 * (j // 16)) % 255')})::BIGINT AS b2 FROM x GROUP BY ALL)
    SELECT object_id, sum(b1 * (c + 1) * (frag_idx + 1))::BIGINT AS first, sum(b2 * (c + 1) * (frag_idx + 1))::BIGINT AS second FROM p GROUP BY object_id""",
)
def column_parity(spark, sf_dir):
    """Two check cells of 16 bytes for each fragment, told by weighted sums."""

    def run(content, _):
        out, weight = [0, 0], np.arange(1, 17)
        for i in range(0, len(content), 1024):
            cells = parity.column_parity(np.frombuffer(content[i : i + 1024], np.uint8)).astype(np.int64).reshape(2, 16)
            for p in range(2):
                out[p] += int((cells[p] * weight).sum()) * (i // 1024 + 1)
        return tuple(out)

    return parity.per_object(objects(spark, sf_dir).where(F.octet_length("content") > 0), run, "first long, second long")


@register(
    "row_recover",
    f"""WITH {OBJECTS} SELECT object_id, (object_id % ((n + 255) // 256))::INTEGER AS lost, sha256(content[(object_id % ((n + 255) // 256)) * 256 + 1 : (object_id % ((n + 255) // 256)) * 256 + 256]) AS hash FROM objects WHERE n > 0""",
)
def row_recover(spark, sf_dir):
    """One lost piece of each object, from the others and the check row."""

    def run(content, object_id):
        pieces = -(-len(content) // 256)
        lost = object_id % pieces
        back = parity.recovered_row(content, 256, lost)[: min(256, len(content) - 256 * lost)]
        return lost, hashlib.sha256(back).hexdigest()

    return parity.per_object(objects(spark, sf_dir).where(F.octet_length("content") > 0), run, "lost int, hash string")


def _loss(blocks: int, object_id: int, share: float) -> np.ndarray:
    """Deterministic losses."""
    i = np.arange(blocks)
    return (object_id * 31 + i * 7) % 97 < 97 * share


def _recovery(spark, sf_dir, code: str, share: float):
    def run(content, object_id):
        blocks = -(-len(content) // 256)
        lost = _loss(blocks, object_id, share)
        back, still = parity.fountain_recovery(content, 256, code, lost)
        return blocks, int(lost.sum()), still, hashlib.sha256(back).hexdigest() == hashlib.sha256(content).hexdigest()

    return parity.per_object(objects(spark, sf_dir), run, "blocks int, lost int, still_lost int, restored boolean")


@register("lt_decode")
def lt_decode(spark, sf_dir):
    return _recovery(spark, sf_dir, "lt", 0.05)


@register("duip_decode")
def duip_decode(spark, sf_dir):
    return _recovery(spark, sf_dir, "duip", 0.05)


#: Of the sweep: losses in percent, trials of each, repair symbols by blocks.
LOSSES, TRIALS, RATIOS = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70), 3, (0.5, 1.0, 2.0)


@register("loss_sweep")
def loss_sweep(spark, sf_dir):
    """Of the blocks lost at each share, trial and ratio of repair symbols, how many both codes leave lost."""

    def run(content, object_id):
        m, out = parity.matrix(content, 256), []
        for ratio in RATIOS:
            codes = [(e, fountain.symbols(m, e)) for e in (fountain.lt_equations(len(m), ratio), fountain.duip_equations(len(m), ratio))]
            for share in LOSSES:
                for trial in range(TRIALS):
                    lost = _loss(len(m), object_id + 7 * trial, share / 100)
                    left = [int(fountain.decoded(m, lost, e, values)[1].sum()) for e, values in codes]
                    out.append({"ratio": ratio, "loss": share, "trial": trial, "lost": int(lost.sum()), "lt_left": left[0], "duip_left": left[1]})
        return (out,)

    per = parity.per_object(objects(spark, sf_dir), run, "xs array<struct<ratio:double,loss:int,trial:int,lost:long,lt_left:long,duip_left:long>>")
    rows = per.select(F.explode("xs").alias("x")).select("x.*")
    return rows.groupBy("ratio", "loss", "trial").agg(*(F.sum(c).alias(c) for c in ("lost", "lt_left", "duip_left")))


def edges(spark, sf_dir, code: str):
    """blocks, symbol_id, member for the numbers of blocks that occur, made where they are needed."""
    kinds = objects(spark, sf_dir).select(F.ceil(F.octet_length("content") / 256).cast("int").alias("blocks")).where("blocks > 0").distinct()

    def run(batches):
        import pandas as pd

        for b in batches:
            for k in b["blocks"]:
                eq = (fountain.lt_equations if code == "lt" else fountain.duip_equations)(int(k))
                s, m = np.repeat(np.arange(len(eq)), [len(e) for e in eq]), np.concatenate([*eq, np.empty(0, np.int64)])
                yield pd.DataFrame({"blocks": np.full(len(s), k, np.int32), "symbol_id": s.astype(np.int32), "member": m.astype(np.int32)})

    return kinds.mapInPandas(run, "blocks int, symbol_id int, member int")


@register("lt_symbols")
def lt_symbols(spark, sf_dir):
    """Symbols as a join of blocks with edges and an aggregate of words, folded to one number each."""
    o = objects(spark, sf_dir).withColumn("blocks", F.ceil(F.octet_length("content") / 256).cast("int"))
    b = chunking.split(o, 256, ordinal="block_idx", keep=("object_id", "blocks"))
    s = parity.symbols_of(b, edges(spark, sf_dir, "lt"))
    return s.groupBy("object_id", "symbol_id").agg(F.bit_xor("value").alias("folded"), F.count(F.lit(1)).alias("words"))


@register("duip_symbols")
def duip_symbols(spark, sf_dir):
    o = objects(spark, sf_dir).withColumn("blocks", F.ceil(F.octet_length("content") / 256).cast("int"))
    b = chunking.split(o, 256, ordinal="block_idx", keep=("object_id", "blocks"))
    s = parity.symbols_of(b, edges(spark, sf_dir, "duip"))
    return s.groupBy("object_id", "symbol_id").agg(F.bit_xor("value").alias("folded"), F.count(F.lit(1)).alias("words"))


@register(
    "replicated_fragments",
    f"""WITH {OBJECTS}, {blocks_sql(256)} SELECT a.object_id, a.block_idx::INTEGER AS frag_idx, count(*)::BIGINT AS blocks, sum(octet_length(b.data) + 8)::BIGINT AS bytes, min(left(sha256(b.data), 16)) AS least_mark
    FROM blocks a JOIN blocks b ON a.object_id = b.object_id GROUP BY ALL""",
)
def replicated_fragments(spark, sf_dir):
    """Full replication: each fragment carries every block of its object with a short digest before it."""
    b = chunking.split(objects(spark, sf_dir), 256, ordinal="block_idx").select("object_id", "block_idx", "data")
    r = rings.replicated(b)
    return r.groupBy("object_id", "frag_idx").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("data") + 8).alias("bytes"), F.min("mark").alias("least_mark"))
