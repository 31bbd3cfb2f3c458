"""Chat formatting: tool calls and their results, linked, ordered, validated and serialised.  DataFrame functions only.

An assistant turn whose text is a JSON object with a ``tool_calls`` array holds calls {id, name, arguments}; a tool turn
whose text is a JSON object with ``tool_call_id`` holds a result {tool_call_id, content}; any other turn is a message.
Calls and results are hash-joined by (conversation, id).  A call may use an earlier one's result by an argument string
``$ref:<id>`` (an id without quotes and backslashes); calls get topological levels (1 + the highest level that they refer
to).  Arguments, an object or a string that holds one, are checked against the named tool's schema.  Every row is serialised as canonical JSON: keys sorted, no white space, numbers normalised.

A row of the result is a message, a call or a result; conversations are never gathered, so one of any length is spread
over tasks, and ids with more than ``HOT`` calls or results are not shuffled together.  Order of a conversation: turn,
level, position.

Results: null text is a message with content null.  JSON that does not parse, lacks what is named above or is larger than
a variant may be is a message.  Rows without conv_id, turn or role are messages of no conversation.
Of calls with one id in a conversation the first (by turn, position) is linked, others are ``duplicate_call``; of
results likewise.  Calls that refer to each other in a circle have no level and are ``cyclic``.  Repeated rows are
repeated in the result.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Calls and results of one id from which they are joined where they stand.
HOT = 100_000
#: tool name -> parameter -> (JSON type: string, integer, number, boolean, array or object; required)
Schemas = dict[str, dict[str, tuple[str, bool]]]
#: What schema_of_variant calls a value of each JSON type.
VARIANT_TYPE = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}


def split_turns(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of a table (conv_id, turn, role, text)."""
    is_json = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("role").isin("assistant", "tool") & F.startswith(F.ltrim("text"), F.lit("{"))
    base = df.select("conv_id", "turn", "role", "text", F.when(is_json, F.try_parse_json("text")).alias("v"))
    listed = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    result_id = F.try_variant_get("v", "$.tool_call_id", "string")
    base = base.withColumn("calls", F.when(F.col("role") == "assistant", listed)).withColumn("result_id", F.when(F.col("role") == "tool", result_id))
    sound = F.filter("calls", lambda c: F.try_variant_get(c, "$.id", "string").isNotNull() & F.try_variant_get(c, "$.name", "string").isNotNull())
    base = base.withColumn("calls", F.when(F.size(sound) > 0, sound))
    messages = base.filter("calls IS NULL AND result_id IS NULL").select("conv_id", "turn", "role", "text")
    one = base.filter("calls IS NOT NULL").select("conv_id", "turn", F.posexplode("calls").alias("pos", "c"))
    raw = F.try_variant_get("c", "$.arguments", "variant")
    given = F.coalesce(F.try_parse_json(F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get("c", "$.arguments", "string"))), raw)
    calls = one.select("conv_id", "turn", "pos", F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("name"), given.alias("arguments"))
    results = base.filter("result_id IS NOT NULL").select("conv_id", "turn", F.lit(0).alias("pos"), F.col("result_id").alias("call_id"), F.try_variant_get("v", "$.content", "variant").alias("content"))
    return messages, calls, results


def argument_errors(schemas: Schemas) -> Column:
    """Names of parameters that are missing, unknown or of a wrong type; ``*`` if the tool is unknown or gets no object."""
    keys = F.coalesce(F.json_object_keys(F.to_json(F.col("arguments"))), F.array().cast("array<string>"))
    found = F.array(F.lit("*"))
    no_object = F.coalesce(~F.startswith(F.schema_of_variant("arguments"), F.lit("OBJECT")), F.lit(True))
    for tool, parameters in sorted(schemas.items()):
        wrong = [F.array_except(keys, F.array(*(F.lit(p) for p in sorted(parameters))).cast("array<string>"))]
        for p, (kind, required) in sorted(parameters.items()):
            value = F.try_variant_get("arguments", f"$['{p}']", "variant")
            bad = F.coalesce(~F.rlike(F.schema_of_variant(value), F.lit(VARIANT_TYPE[kind])), F.lit(required))
            wrong.append(F.when(bad, F.array(F.lit(p))).otherwise(F.array().cast("array<string>")))
        found = F.when(F.col("name") == tool, F.when(no_object, F.array(F.lit("*"))).otherwise(F.array_sort(F.array_distinct(F.concat(*wrong))))).otherwise(found)
    return found


def references() -> Column:
    """Ids in argument strings ``$ref:<id>``: in JSON as Spark writes it, values follow : , or [ and keys precede a colon."""
    return F.array_distinct(F.regexp_extract_all(F.to_json("arguments"), F.lit(r'(?<=[:,\[])"\$ref:([^"\\]+)"(?!:)'), F.lit(1)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, refs), unique by id: 0 for calls that refer to no call of
    their conversation, else 1 + the highest level referred to; calls in or behind circles are left out.

    Calls with one reference are chains: their pointers double in each round, so a chain of n calls takes log2(n) rounds.
    Calls with several are settled front by front over the contracted chains, each round writing only what is new.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key)
    edges = materialize(calls.select(*key, F.explode("refs").alias("end")).join(nodes.withColumnRenamed("call_id", "end"), ["conv_id", "end"], "left_semi"))
    degree = edges.groupBy(*key).agg(F.count("*").alias("n"))
    roots = nodes.join(degree, key, "left_anti").withColumn("level", F.lit(0))
    if not edges.take(1):
        return roots
    settled = materialize(roots)
    chain = materialize(edges.join(degree.filter("n = 1").select(*key), key, "left_semi").withColumn("far", F.lit(1).cast("long")))
    several = edges.join(degree.filter("n > 1").select(*key), key, "left_semi")
    # Done are pointers at calls that are no link of a chain.
    done, open_, rounds = None, chain, max(1, chain.count()).bit_length()
    for _ in range(rounds):
        step = open_.alias("a").join(open_.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.end") == F.col("b.call_id")), "left")
        step = step.select("a.conv_id", "a.call_id", F.coalesce("b.end", "a.end").alias("end"), (F.col("a.far") + F.coalesce("b.far", F.lit(0))).alias("far"), F.col("b.end").isNull().alias("done"))
        if done is not None:
            # What a pointer meets may be done already: then its end is where that one's chain ends.
            met = done.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("last"), F.col("far").alias("more"))
            step = step.join(met, ["conv_id", "end"], "left").select("conv_id", "call_id", F.coalesce("last", "end").alias("end"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), (F.col("done") | F.col("last").isNotNull()).alias("done"))
        step = materialize(step)
        new, open_ = step.filter("done").drop("done"), step.filter("NOT done").drop("done")
        done = new if done is None else done.unionByName(new)
        if not open_.take(1):
            break
    found = settled
    links = several.withColumn("far", F.lit(1).cast("long"))
    if done is not None:
        short = done.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("last"), F.col("far").alias("more"))
        stuck = open_.select("conv_id", F.col("call_id").alias("end")).distinct()
        links = links.join(short, ["conv_id", "end"], "left").select(*key, F.coalesce("last", "end").alias("end"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        # A reference into a circle is never settled: it stays as one that no front reaches.
        links = links.join(stuck, ["conv_id", "end"], "left_anti").unionByName(links.join(stuck, ["conv_id", "end"], "left_semi").withColumn("end", F.lit(None).cast("string")))
    waiting = materialize(links)
    while waiting.take(1):
        step = waiting.join(found.select("conv_id", F.col("call_id").alias("end"), "level"), ["conv_id", "end"], "left")
        ready = step.groupBy(*key).agg(F.max(F.col("level") + F.col("far")).cast("int").alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        front = materialize(ready.filter("open = 0").select(*key, "level"))
        if not front.take(1):
            break
        found = found.unionByName(front)
        waiting = materialize(waiting.join(front.select(*key), key, "left_anti"))
    if done is not None:
        ends = found.select("conv_id", F.col("call_id").alias("end"), "level")
        found = found.unionByName(done.join(ends, ["conv_id", "end"]).select(*key, (F.col("level") + F.col("far")).cast("int").alias("level")))
    return found


def _with_facts(rows: DataFrame, facts: DataFrame, hot: int) -> DataFrame:
    """rows with the facts of their (conv_id, call_id); rows of an id that has more than ``hot`` stay where they are."""
    key, many = ["conv_id", "call_id"], facts.filter(F.col("n") > hot)
    if not many.take(1):
        return rows.join(facts.drop("n"), key)
    few = F.broadcast(many.drop("n"))  # at most one for each ``hot`` calls or results
    rest = rows.join(F.broadcast(many.select(*key)), key, "left_anti").join(facts.filter(F.col("n") <= hot).drop("n"), key)
    return rows.join(few, key).unionByName(rest)


def link(df: DataFrame, schemas: Schemas | None = None, hot: int = HOT) -> DataFrame:
    """conv_id, turn, pos, kind, call_id, name, level, status, errors and json (canonical), a row for each message, call, result."""
    messages, calls, results = split_turns(df.selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "role", "text"))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    no_errors = F.array().cast("array<string>")
    out = messages.select("conv_id", "turn", F.lit(0).alias("pos"), F.lit("message").alias("kind"), none.alias("call_id"), none.alias("name"), F.lit(0).alias("level"), F.lit("message").alias("status"), no_errors.alias("errors"), plain.alias("json"))
    errors = argument_errors(schemas) if schemas is not None else no_errors
    call_json = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", F.lit("call").alias("type")), {"ignoreNullFields": "false"})
    result_json = F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")), {"ignoreNullFields": "false"})
    calls = calls.select("conv_id", "turn", "pos", "call_id", "name", errors.alias("errors"), references().alias("refs"), call_json.alias("json"))
    # Numbered when they are written, so that what comes first among rows of one place is settled once and for all.
    calls = materialize(calls.withColumn("uid", F.monotonically_increasing_id()))
    results = materialize(results.select("conv_id", "turn", "pos", "call_id", result_json.alias("json")).withColumn("uid", F.monotonically_increasing_id()))
    if not calls.take(1) and not results.take(1):
        return out
    key, at = ["conv_id", "call_id"], F.struct("turn", "pos", "uid")
    first_call = calls.groupBy(*key).agg(F.min(F.struct("turn", "pos", "uid", "name")).alias("c"), F.count("*").alias("calls"))
    first_call = materialize(first_call.select(*key, F.struct("c.turn", "c.pos", "c.uid").alias("call_at"), F.col("c.name").alias("first_name"), "calls"))
    first_result = results.groupBy(*key).agg(F.min(at).alias("result_at"), F.count("*").alias("results"))
    main = _with_facts(calls.select(*key, "turn", "pos", "uid", "refs"), first_call.select(*key, "call_at", F.col("calls").alias("n")), hot).filter(at == F.col("call_at"))
    facts = first_call.join(levels(main.select(*key, "refs")), key, "left").join(first_result, key, "full")
    facts = materialize(facts.withColumn("n", F.greatest(F.coalesce("calls", F.lit(0)), F.coalesce("results", F.lit(0)))).drop("calls", "results"))
    status = (
        F.when(at != F.col("call_at"), "duplicate_call")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.size("errors") > 0, "invalid_arguments")
        .when(F.col("result_at").isNull(), "no_result")
        .otherwise("linked")
    )
    linked = _with_facts(calls.drop("refs"), facts, hot)
    call_rows = linked.select("conv_id", "turn", "pos", F.lit("call").alias("kind"), "call_id", "name", F.when(at == F.col("call_at"), F.col("level")).alias("level"), status.alias("status"), "errors", "json")
    status = (
        F.when(F.col("call_at").isNull(), "no_call")
        .when(at != F.col("result_at"), "duplicate_result")
        .when(F.col("turn") < F.col("call_at.turn"), "early_result")
        .otherwise("linked")
    )
    linked = _with_facts(results, facts, hot)
    result_rows = linked.select("conv_id", "turn", "pos", F.lit("result").alias("kind"), "call_id", F.col("first_name").alias("name"), "level", status.alias("status"), no_errors.alias("errors"), "json")
    return out.unionByName(call_rows).unionByName(result_rows)
