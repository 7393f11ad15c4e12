"""Chat formatting by tool-call linking (DataFrame functions only).

An assistant turn whose text is a JSON object with `tool_calls` [{id, name, arguments, depends_on?}] makes calls; a turn
whose text is an object with `tool_call_id` is a result.  Calls and results are hash-joined by conversation and
identifier after each side was reduced to its first row per identifier, so a repeated identifier cannot flood a task.
Order is topological over turns: a turn comes after the turns whose calls its own depend on, a result after the turn that
made its call, otherwise turns keep their order; calls of one turn stand in their order of dependency.  It is given as
sort keys, which need no window over a conversation.  Dependencies are followed by ways that grow with every round, so a
chain takes a round for each doubling of its length; those inside a cycle are found by reachability and left out.
Arguments are held against the tools' schemas; messages are canonical JSON: keys sorted at every level, no spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

TOOLS = "tool string, argument string, type string, required boolean"

#: A turn's ways times those of a turn they lead to, up to which they are followed at once; more while a round's sum allows.
WAYS, WAYS_A_ROUND = 128, 1 << 20


def canonical(value: Column) -> Column:
    """A variant as JSON with sorted keys."""
    return F.to_json(value)


def _fits(kind: Column, wanted: Column) -> Column:
    return (
        F.when(wanted == "string", kind == "STRING")
        .when(wanted == "integer", kind == "BIGINT")
        .when(wanted == "number", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        .when(wanted == "boolean", kind == "BOOLEAN")
        .when(wanted == "array", kind.startswith("ARRAY"))
        .when(wanted == "object", kind.startswith("OBJECT"))
        .otherwise(F.lit(False))
    )


def _by_dependency(calls: Column) -> Column:
    """Calls of one turn, each after those of the turn that it depends on; calls in a cycle keep their order."""
    ids = F.transform(calls, lambda c: c["id"])
    needs = F.transform(calls, lambda c: F.array_intersect(F.coalesce(c["depends_on"], F.array().cast("array<string>")), ids))
    # Each pass doubles how far back `needs` reaches; a call reaches more of its turn than any call that it needs.
    further = lambda acc, _: F.transform(acc, lambda n: F.array_distinct(F.concat(n, F.flatten(F.transform(n, lambda d: F.element_at(acc, F.array_position(ids, d).cast("int")))))))
    reach = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(calls))).cast("int")), needs, further)
    places = F.array_sort(F.transform(reach, lambda n, i: F.struct(F.size(F.array_union(n, F.array(F.element_at(ids, i + 1)))).alias("n"), i.alias("i"))))
    return F.when(F.exists(needs, lambda n: F.size(n) > 0), F.transform(places, lambda p: F.element_at(calls, p["i"] + 1))).otherwise(calls)


def parsed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and calls and result of turns that are JSON objects of those shapes."""
    text, role = F.col("text").cast("string"), F.col("role").cast("string")
    looks = text.rlike(r"^\s*\{") & text.rlike(r'"tool_call')
    v = F.when(looks, F.try_parse_json(text))
    call = "array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>"
    calls = F.filter(F.try_variant_get(v, F.lit("$.tool_calls"), call), lambda c: c["id"].isNotNull() & c["name"].isNotNull())
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.when(role == "assistant", calls).alias("calls"),
        F.when(role != "assistant", F.try_variant_get(v, F.lit("$.tool_call_id"), "string")).alias("result_of"),
        F.when(looks, F.try_variant_get(v, F.lit("$.content"), "variant")).alias("content"),
    )
    return rows.withColumn("calls", F.when(F.size("calls") > 1, _by_dependency(F.col("calls"))).otherwise(F.col("calls")))


def _in_cycles(needs: DataFrame) -> DataFrame:
    """The rows of needs (conv_id, turn, needed) whose two turns reach each other."""
    reach, n = needs, -1
    while (now := reach.count()) != n:
        n = now
        on = reach.select("conv_id", F.col("turn").alias("needed"), F.col("needed").alias("far"))
        reach = written(reach.union(reach.join(on, ["conv_id", "needed"]).select("conv_id", "turn", "far")).distinct(), "reach")
    back = reach.select("conv_id", F.col("needed").alias("turn"), F.col("turn").alias("needed"))
    return needs.join(back, ["conv_id", "turn", "needed"], "left_semi")


def _followed(needs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """conv_id, turn, at, step of the turns of needs (conv_id, turn, needed; distinct) in conversations without a cycle,
    and conv_id, turn of turns of the others: all that reach a cycle are among them.

    A turn keeps its latest place so far and ways on, each to a turn that lies `links` dependencies off.  In a round a
    way takes over the place of the turn it leads to and goes on by that turn's ways: none, it ends; one, it gets longer,
    so chains and trees take a round for each doubling of their depth; several, as long as `WAYS` allows, else it stays,
    and the turns without ways left shorten it.  Of ways to one turn the longest counts.  No turn has more ways than its
    dependencies or that bound.
    """
    ways = needs.select("conv_id", "turn", F.struct("needed", F.lit(1).alias("links")).alias("way")).unionByName(needs.select("conv_id", F.col("needed").alias("turn")), allowMissingColumns=True)
    # a path without a cycle has no more links than its conversation has turns with dependencies
    most = needs.groupBy("conv_id").agg(F.countDistinct("turn").alias("most"))
    now = ways.groupBy("conv_id", "turn").agg(F.collect_list("way").alias("ways")).join(most, "conv_id")
    now = written(now.select("conv_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("step"), "ways", "most"), "places")
    n_ways = F.size("ways")
    cycle = F.exists("ways", lambda w: (w["needed"] == F.col("turn")) | (w["links"] > F.col("most"))) | (F.col("step") > 2 * F.col("most"))
    in_cycles = []
    while True:
        n, any_cycle = now.agg(F.count_if(n_ways > 0), F.bool_or(cycle)).first()
        if any_cycle:
            held, found = now, now.where(cycle).select("conv_id").distinct()
            in_cycles.append(written(now.where(n_ways > 0).join(found, "conv_id", "left_semi").select("conv_id", "turn"), "cycles"))
            now = written(now.join(found, "conv_id", "left_anti"), "places")
            dropped(held)
            continue
        if not n:
            break
        most_ways = max(WAYS, WAYS_A_ROUND // n)
        way = now.select("conv_id", "turn", n_ways.cast("long").alias("own"), F.explode("ways").alias("way")).select("conv_id", "turn", "own", "way.needed", "way.links")
        known = now.select("conv_id", F.col("turn").alias("needed"), "at", "step", n_ways.alias("n"), F.when(n_ways <= most_ways, F.col("ways")).alias("further"))
        on = F.transform("further", lambda w: F.struct(w["needed"].alias("needed"), (w["links"] + F.col("links")).alias("links")))
        on = F.when((F.col("n") < 2) | (F.col("own") * F.col("n") <= most_ways), on).otherwise(F.array(F.struct("needed", "links")))
        after = F.struct("at", (F.col("step") + 2 * F.col("links")).alias("step"))
        seen = way.join(known, ["conv_id", "needed"]).groupBy("conv_id", "turn").agg(F.max(after).alias("after"), F.array_sort(F.flatten(F.collect_list(on))).alias("on"))
        longest = F.filter("on", lambda w, i: F.coalesce(F.get("on", i + 1)["needed"] != w["needed"], F.lit(True)))
        own = F.struct("at", "step")
        place = F.greatest(own, F.coalesce("after", own))
        held, now = now, now.join(seen, ["conv_id", "turn"], "left").select("conv_id", "turn", place.alias("place"), F.coalesce(longest, "ways").alias("ways"), "most")
        now = written(now.select("conv_id", "turn", "place.at", "place.step", "ways", "most"), "places")
        dropped(held)
    return now.select("conv_id", "turn", "at", "step"), reduce(DataFrame.unionByName, in_cycles) if in_cycles else None


def _among(needs: DataFrame, turns: DataFrame) -> DataFrame:
    """The rows of needs (conv_id, turn, needed) between two of `turns`."""
    return needs.join(turns, ["conv_id", "turn"], "left_semi").join(turns.withColumnRenamed("turn", "needed"), ["conv_id", "needed"], "left_semi").select("conv_id", "turn", "needed")


def _ordered(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, at, step: the place of a call's turn, which all calls of the turn share."""
    calls = written(calls, "calls")
    made = calls.select("conv_id", F.col("call_id").alias("needed_id"), F.col("turn").alias("needed"))
    needs = calls.select("conv_id", "turn", F.explode("depends_on").alias("needed_id")).join(made, ["conv_id", "needed_id"]).where("turn <> needed")
    needs = written(needs.select("conv_id", "turn", "needed").distinct(), "needs")
    against = needs.where("needed > turn").select("conv_id").distinct()
    if against.isEmpty():
        return calls.select("conv_id", "call_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("step"))
    places, turns = _followed(needs.join(against, "conv_id", "left_semi"))
    if turns is not None:
        inner = written(_among(needs, turns), "inner")
        _, behind = _followed(inner.select("conv_id", F.col("needed").alias("turn"), F.col("turn").alias("needed")))
        cycles = _in_cycles(written(_among(inner, behind), "reach"))
        rest = needs.join(turns.select("conv_id").distinct(), "conv_id", "left_semi").join(cycles, ["conv_id", "turn", "needed"], "left_anti")
        places = places.unionByName(_followed(written(rest, "needs"))[0])
    return calls.join(places, ["conv_id", "turn"], "left").select("conv_id", "call_id", "turn", F.coalesce("at", "turn").alias("at"), F.coalesce("step", F.lit(0)).alias("step"))


def validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with `valid`: a known tool, all required arguments, no unknown ones, each of its type."""
    known = tools.groupBy("tool").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("argument").isNotNull(), F.struct("argument", F.struct("type", "required"))))).alias("wanted")
    )
    got = F.coalesce(F.try_variant_get("arguments", F.lit("$"), "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    joined = calls.join(known, F.col("name") == F.col("tool"), "left").withColumn("got", got)
    typed = F.forall(F.map_entries("got"), lambda e: F.coalesce(_fits(F.schema_of_variant(e["value"]), F.try_element_at(F.col("wanted"), e["key"])["type"]), F.lit(False)))
    complete = F.forall(F.map_entries("wanted"), lambda e: ~F.coalesce(e["value"]["required"], F.lit(False)) | F.array_contains(F.map_keys("got"), e["key"]))
    return joined.withColumn("valid", F.col("wanted").isNotNull() & F.coalesce(typed & complete, F.lit(False)))


def format_chats(turns: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, turn, role, order_turn, order_step, n_calls, n_linked, n_valid, link_turn, message: one row per turn.

    Sorted by (order_turn, order_step, turn), the messages of a conversation are in topological order.  `link_turn` is
    the call's turn of a result, or the first result's turn of a turn with calls; null without a partner.  Of repeated
    identifiers the first turn counts.  Text that is null gives content null; text that is no call or result stays
    text; calls without id or name are left out; a null conv_id or turn links nothing and keeps its place.  Repeated
    rows give a row each.  `tools` is (tool, argument, type, required), one row per argument or one with argument null;
    it is a parameter of bounded size.  Other columns are not read.
    """
    rows = parsed_turns(turns)
    calls = rows.where(F.size("calls") > 0).select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.expr("cast(array() as array<string>)")).alias("depends_on"))
    calls = written(validated(calls, tools).select("conv_id", "turn", "call_id", "valid", "depends_on"), "all-calls")
    results = rows.where("result_of is not null").groupBy("conv_id", F.col("result_of").alias("call_id")).agg(F.min("turn").alias("result_turn"))
    if calls.isEmpty():
        ordered, linked_ = None, None
    else:
        first = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"), F.min_by("depends_on", "turn").alias("depends_on"))
        ordered = _ordered(first)
        linked_ = written(ordered.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left"), "links")
    plain = F.struct(F.col("text").alias("content"), F.col("role").alias("role"))
    content = F.when(F.col("content").isNotNull(), canonical(F.col("content"))).otherwise(F.lit("null"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    one = lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(canonical(c["arguments"]), F.lit("{}")), F.lit(',"id":'), quoted(c["id"]), F.lit(',"name":'), quoted(c["name"]), F.lit("}"))
    message = (
        F.when(F.size("calls") > 0, F.concat(F.lit('{"content":'), content, F.lit(',"role":"assistant","tool_calls":['), F.array_join(F.transform("calls", one), ","), F.lit("]}")))
        .when(F.col("result_of").isNotNull(), F.concat(F.lit('{"content":'), content, F.lit(',"role":'), quoted(F.col("role")), F.lit(',"tool_call_id":'), quoted(F.col("result_of")), F.lit("}")))
        .otherwise(F.to_json(plain, {"ignoreNullFields": "false"}))
    )
    base = rows.select("conv_id", "turn", "role", F.greatest(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"), "result_of", message.alias("message"))
    none = F.lit(None).cast("long")
    if linked_ is None:
        return base.select("conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), "n_calls", F.lit(0).cast("long").alias("n_linked"), F.lit(0).cast("long").alias("n_valid"), none.alias("link_turn"), "message")
    per_turn = calls.groupBy("conv_id", "turn").agg(F.count_if("valid").alias("v")).join(
        linked_.groupBy("conv_id", "turn").agg(F.count("result_turn").alias("l"), F.min("result_turn").alias("r"), F.max(F.struct("at", "step")).alias("o")), ["conv_id", "turn"], "left"
    )
    per_turn = written(per_turn, "turns-with-calls")
    of_result = linked_.where("result_turn is not null").select("conv_id", F.col("call_id").alias("result_of"), F.col("turn").alias("t"), "at", "step", "result_turn")
    out = base.join(per_turn, ["conv_id", "turn"], "left").join(written(of_result, "results"), ["conv_id", "result_of"], "left")
    mine = F.col("result_turn") == F.col("turn")
    order = F.when(F.col("o").isNotNull(), F.col("o")).when(mine, F.greatest(F.struct(F.col("turn").alias("at"), F.lit(0).alias("step")), F.struct("at", (F.col("step") + 1).alias("step"))))
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce(order["at"], "turn").alias("order_turn"),
        F.coalesce(order["step"], F.lit(0)).alias("order_step"),
        "n_calls",
        F.coalesce("l", F.when(mine, F.lit(1)), F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("v", F.lit(0)).cast("long").alias("n_valid"),
        F.coalesce("r", F.when(mine, F.col("t"))).alias("link_turn"),
        "message",
    )
