"""Tool calls: link calls and results, order them topologically, validate arguments, write canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.llm.common import bind, discard, stash

#: Schemas of the calls that tool_traffic derives: field -> (type, required). Types: string, number, boolean, array, object.
SCHEMAS = {
    "configure": {"text": ("string", True)},
    "ask": {"n_chars": ("number", True), "text": ("string", True), "follows": ("string", False)},
}

#: Turns of one conversation that a task puts in order, and calls of one that are gathered in a row at most.
STRETCH, IN_ROW = 4096, 8192


def tool_traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: a user turn calls `ask`, a system turn `configure`, and an assistant turn is the
    result of the turn before it. A call depends on the one before it in its conversation."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    calls = turns.where("role in ('user', 'system')")
    # The call before: within a stretch of turns by a window, across stretches by their last calls, so a long conversation is not one task.
    calls = calls.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    last = calls.groupBy("conv_id", "stretch").agg(F.max("turn").alias("last"))
    last = last.select("conv_id", "stretch", F.lag("last").over(W.partitionBy("conv_id").orderBy("stretch")).alias("earlier"))
    within = F.max("turn").over(W.partitionBy("conv_id", "stretch").orderBy("turn").rangeBetween(W.unboundedPreceding, -1))
    calls = calls.withColumn("within", within).join(last, ["conv_id", "stretch"]).withColumn("before", F.coalesce("within", "earlier"))
    follows = F.when(F.col("before").isNotNull(), call_id(F.col("before")))
    ask = F.to_json(F.struct(F.col("text"), F.char_length("text").alias("n_chars"), follows.alias("follows")))
    calls = calls.select(
        "conv_id",
        call_id(F.col("turn")).alias("call_id"),
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", ask).otherwise(F.to_json(F.struct("text"))).alias("arguments"),
        F.when(follows.isNotNull(), F.array(follows)).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def argument_errors(schemas: Mapping[str, Mapping[str, tuple[str, bool]]], name: Column, arguments: Column) -> Column:
    """Sorted messages: not an object, unknown tool, missing, wrong type, unknown field. Empty means valid."""
    parsed = F.try_parse_json(arguments)
    kinds = {"string": ["STRING"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
    checks = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        parts = []
        for field, (kind, required) in fields.items():
            path = f"$['{field}']"
            value = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
            wrong = ~F.regexp_extract(value, "^[A-Z]+", 0).isin(*kinds[kind])
            missing = F.try_variant_get(parsed, path, "variant").isNull() | (value == "VOID")
            parts.append(F.when(missing, F.lit(f"missing: {field}") if required else None).when(wrong, F.lit(f"not a {kind}: {field}")))
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), known), lambda k: F.concat(F.lit("unknown field: "), k))
        checks = F.when(name == tool, F.concat(F.array(*parts).cast("array<string>"), extra)).otherwise(checks)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    checks = F.when(is_object, checks).otherwise(F.array(F.lit("not an object")))
    return F.array_sort(F.filter(checks, lambda e: e.isNotNull()))


def _levels_within(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of conversations that fit a row: each wave gives a level to all calls whose dependencies have one."""

    def ordered(c: Column) -> Column:
        ids = F.transform(c, lambda x: x["id"])
        at = lambda d: F.array_position(ids, d)
        return F.struct(ids.alias("ids"), F.transform(c, lambda x: F.transform(F.filter(F.array_distinct(x["d"]), lambda d: F.coalesce(at(d), F.lit(0)) > 0), lambda d: (at(d) - 1).cast("int"))).alias("deps"))

    def levels(x: Column) -> Column:
        def wave(acc: Column, _: Column) -> Column:
            level = lambda d: F.get(acc["levels"], d)
            ready = lambda deps: F.when(F.forall(deps, lambda d: level(d) >= 0), F.coalesce(F.array_max(F.transform(deps, level)), F.lit(-1)) + 1).otherwise(-1)
            new = F.transform(acc["levels"], lambda v, i: F.when(v >= 0, v).otherwise(ready(F.get(x["deps"], i))))
            return F.when(acc["moved"], bind(new, lambda n: F.struct(n.alias("levels"), (n != acc["levels"]).alias("moved")))).otherwise(acc)

        n = F.size(x["ids"])
        found = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.array_repeat(F.lit(-1), n).alias("levels"), F.lit(True).alias("moved")), wave)["levels"]
        return F.arrays_zip(x["ids"].alias("id"), found.alias("level"))

    listed = calls.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("call_id").alias("id"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("d")))).alias("c"))
    flat = listed.select("conv_id", F.explode(bind(bind(F.col("c"), ordered), levels)).alias("x"))
    return flat.select("conv_id", F.col("x.id").alias("call_id"), F.when(F.col("x.level") >= 0, F.col("x.level").cast("long")).alias("level"))


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without known dependencies, else one more than the highest dependency; null on or behind a cycle.

    A conversation of at most IN_ROW calls is one row, whose levels are found within it, however deep its calls nest; a longer one is
    never gathered, but worked on by joins (see _levels_by_rounds).
    """
    calls = calls.dropDuplicates(["conv_id", "call_id"])
    long = stash(calls.groupBy("conv_id").count().where(F.col("count") > IN_ROW).select("conv_id"), "long")
    if long.isEmpty():
        return _levels_within(calls)
    parts = [calls.join(long, "conv_id", how) for how in ("left_anti", "left_semi")]
    return _levels_within(parts[0]).unionByName(_levels_by_rounds(parts[1]))


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """The levels of long conversations.

    Chains (calls with one dependency) are followed by pointer doubling, in as many rounds as the logarithm of the longest.
    What is left are calls with several dependencies; each round gives a level to those whose dependencies all have one.
    So there are as many rounds as the longest path has calls with several dependencies, whatever lies between
    them and however many calls there are. Every round is a join on ids of the calls still open, written to the shared folder, and
    so are every few rounds' levels; tables that no later round reads are deleted.
    """
    key = F.struct("conv_id", "call_id")
    nodes = stash(calls.select(key.alias("k"), "depends_on").dropDuplicates(["k"]), "nodes")
    total = nodes.count()
    edges = nodes.select("k", F.explode(F.array_distinct("depends_on")).alias("d")).where("d is not null")
    edges = edges.select("k", F.struct(F.col("k.conv_id").alias("conv_id"), F.col("d").alias("call_id")).alias("up"))
    edges = stash(edges.join(nodes.select(F.col("k").alias("up")), "up", "left_semi").select("k", "up"), "edges")
    degree = edges.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("up"))

    chain = stash(degree.where("n = 1").select("k", "up", F.lit(1).cast("long").alias("dist")), "chain")
    written = chain
    while True:
        over = chain.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        step = chain.join(over, "up", "left").select("k", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("up2").isNotNull().alias("moved"))
        step = stash(step, "chain")
        discard(written)
        moving = step.where(F.col("moved") & (F.col("dist") <= total)).isEmpty()  # longer ones go round a cycle
        written, chain = step, step.drop("moved")
        if moving:
            break

    ends = chain.select(F.col("k").alias("up"), F.col("up").alias("end"), "dist")
    many = edges.join(degree.where("n > 1").select("k"), "k").join(ends, "up", "left")
    many = stash(many.select("k", F.coalesce("end", "up").alias("up"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")), "many")
    done = stash(nodes.select("k").join(degree.select("k"), "k", "left_anti").select("k", F.lit(0).cast("long").alias("level")), "levels")
    turn = 0
    while not many.isEmpty():
        reached = many.join(done.select(F.col("k").alias("up"), "level"), "up", "left").groupBy("k").agg(F.max(F.col("level") + F.col("dist")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        ready = stash(reached.where("open = 0").select("k", "level"), "levels")
        if ready.isEmpty():
            break
        turn += 1
        done = stash(done.union(ready), "levels") if turn % 8 == 0 else done.union(ready)  # else the plan grows with the rounds
        left = stash(many.join(ready.select("k"), "k", "left_anti"), "many")
        discard(many)
        many = left
    chained = chain.join(done.select(F.col("k").alias("up"), "level"), "up").select("k", (F.col("level") + F.col("dist")).alias("level"))
    return nodes.select("k").join(done.union(chained), "k", "left").select("k.conv_id", "k.call_id", "level")


def link_calls(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call, or per id of results without a call: conv_id, call_id, name, status, level, errors, json.

    Calls (conv_id, call_id, name, arguments, depends_on) and results (conv_id, call_id, content) are joined on their ids by
    a shuffled hash join, calls being the built side. Status is linked, unanswered or orphan (a result without a call). Level orders a
    conversation's calls topologically: sort by (level, call_id). errors lists what the schemas find wrong. json
    is one object with sorted keys, no white space and no nulls: arguments, call_id, depends_on, level, name, result.

    Of repeated calls of one id the smallest (name, arguments) stays, of repeated results the smallest content. Null ids
    form no link: such rows are left out. Null, broken and non-object arguments give the error
    "not an object": null ones are written as null, broken ones as the string they are, others as canonical JSON.
    Dependencies on unknown calls don't count. Other columns are ignored; empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    calls = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("name", "arguments", "depends_on")).alias("c"))
    calls = stash(calls.select(*key, "c.*", F.lit(True).alias("is_call")), "calls")
    results = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min("content").alias("content"), F.lit(True).alias("is_result"))
    both = results.join(calls.join(topological_levels(calls), key).hint("shuffle_hash"), key, "full")
    status = F.when(F.col("is_call").isNull(), "orphan").when(F.col("is_result").isNull(), "unanswered").otherwise("linked")
    # A string as JSON: the array of the string alone, without its brackets.
    quoted = F.regexp_replace(F.to_json(F.array("arguments")), r"(?s)^\[(.*)\]$", "$1")
    args = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.when(F.col("arguments").isNotNull(), quoted), F.lit("null"))
    body = F.to_json(F.struct(F.col("call_id"), F.array_sort(F.array_distinct("depends_on")).alias("depends_on"), "level", "name", F.col("content").alias("result")))
    # Keys are in order already; the arguments, as JSON of their own, stand first.
    text = F.when(F.col("is_call").isNull(), body).otherwise(F.concat(F.lit('{"arguments":'), args, F.lit(","), F.substring(body, 2, 2**31 - 1)))
    errors = F.when(F.col("is_call").isNull(), F.array(F.lit("no call"))).otherwise(argument_errors(schemas, F.col("name"), F.col("arguments")))
    return both.select(*key, "name", status.alias("status"), "level", errors.alias("errors"), text.alias("json"))
