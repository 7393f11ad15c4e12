"""Queries over strategies' overhead and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import planner
from .catalog import register

_VALUES = ", ".join(f"('{s}', '{planner.FAMILY[s]}', {planner.FAMILIES[planner.FAMILY[s]].index(s)}, {planner.OVERHEAD.get(s, 0.0)}::DOUBLE)" for s in planner.FAMILY)
_S = f"s(strategy, family, place, overhead) AS (VALUES {_VALUES})"
_O = "o AS (SELECT o_orderkey, ['FSS1', 'FSS2', 'FSS2R', 'FSS3', 'FSS5', 'FSS5+', 'FSS6', 'FSS6.1', 'FSS6.2'] AS known FROM orders), a AS (SELECT o_orderkey, j AS nth, known[(o_orderkey * (j + 3)) % 9 + 1] AS strategy FROM (SELECT *, unnest([0, 1, 2]) AS j FROM o))"


def strategies(spark):
    return spark.createDataFrame([(s, f, planner.FAMILIES[f].index(s), planner.OVERHEAD.get(s, 0.0)) for s, f in planner.FAMILY.items()], "strategy string, family string, place int, overhead double")


def asked(spark, sf_dir):
    """Three strategies of each order."""
    names = F.array(*map(F.lit, planner.FAMILY))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("nth"))
    return o.withColumn("strategy", F.element_at(names, ((F.col("o_orderkey") * (F.col("nth") + 3)) % 9 + 1).cast("int")))


@register(
    "strategy_overhead",
    f"""WITH {_S}, {_O}, f AS (SELECT o_orderkey, family, arg_min(overhead, nth) AS overhead FROM a JOIN s USING (strategy) GROUP BY ALL)
    SELECT f.o_orderkey, round(greatest(0, sum(overhead) - CASE WHEN bool_or(family = 'etn_validation') AND any_value(p.plus) THEN 4.0 ELSE 0 END), 6) AS overhead
    FROM f JOIN (SELECT o_orderkey, bool_or(strategy = 'FSS5+') AS plus FROM a GROUP BY ALL) p USING (o_orderkey) GROUP BY f.o_orderkey""",
)
def strategy_overhead(spark, sf_dir):
    a = asked(spark, sf_dir).join(F.broadcast(strategies(spark)), "strategy")  # nine rows
    per = a.groupBy("o_orderkey", "family").agg(F.min_by("overhead", "nth").alias("overhead"), F.bool_or(F.col("strategy") == "FSS5+").alias("plus"))
    less = F.when(F.bool_or(F.col("family") == "etn_validation") & F.bool_or("plus"), planner.SHARED_BLOCKS).otherwise(0.0)
    return per.groupBy("o_orderkey").agg(F.round(F.greatest(F.lit(0.0), F.sum("overhead") - less), 6).alias("overhead"))


@register("best_in_family", f"WITH {_S}, {_O} SELECT o_orderkey, family, arg_max(strategy, place) AS best FROM a JOIN s USING (strategy) GROUP BY o_orderkey, family")
def best_in_family(spark, sf_dir):
    a = asked(spark, sf_dir).join(F.broadcast(strategies(spark)), "strategy")
    return a.groupBy("o_orderkey", "family").agg(F.max_by("strategy", "place").alias("best"))


_PLAIN = "family <> 'etn_validation'"


@register(
    "strategy_plans",
    f"""WITH {_S}, p AS (SELECT *, unnest([false, true]) AS with_validation FROM s), q AS (SELECT *, with_validation AND {_PLAIN} AS paired FROM p)
    SELECT strategy, with_validation, strategy AS effective, strategy || CASE WHEN paired THEN ',FSS6' ELSE '' END AS active, CASE WHEN paired THEN 'encode>etn_inject' ELSE 'encode' END AS encode,
           CASE WHEN paired OR strategy = 'FSS6.1' THEN 'etn_strip>strip' ELSE 'strip' END AS restore, greatest(0, overhead + CASE WHEN paired THEN 0.00008::DOUBLE ELSE 0 END - CASE WHEN paired AND strategy = 'FSS5+' THEN 4.0::DOUBLE ELSE 0 END) AS overhead FROM q""",
)
def strategy_plans(spark, sf_dir):
    """The plan of every strategy alone and with validation."""
    rows = [(s, aux, p.effective_primary, ",".join(p.active_strategies), ">".join(x["step"] for x in p.encode_steps), ">".join(x["step"] for x in p.restore_pipeline), p.estimated_overhead) for s in planner.FAMILY for aux in (False, True) for p in [planner.compute(s, [] if aux else None)]]
    return spark.createDataFrame(rows, "strategy string, with_validation boolean, effective string, active string, encode string, restore string, overhead double")
