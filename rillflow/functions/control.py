"""Control-flow functions as column expressions: an error is a column, never an exception."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.log import CHAIN, ORD, chain, invocations, table

INV, C = "WITH" + ORD + " ", "WITH" + CHAIN + " "


def noop(inputs: dict[str, Column]) -> Column:
    """The default input; null without one."""
    return inputs.get("default", F.lit(None).cast("string"))


def compose(inputs: dict[str, Column]) -> Column:
    """Nothing gives null, only a default gives it, else all inputs as JSON."""
    if set(inputs) <= {"default"}:
        return noop(inputs)
    return F.to_json(F.struct(*[v.alias(k) for k, v in inputs.items()]), {"ignoreNullFields": "false"})


def if_(condition: Column, then: Column, otherwise: Column | None = None) -> tuple[Column, Column]:
    """(output, error): a condition that isn't there is an error, not false."""
    out = F.when(condition, then)
    return out if otherwise is None else F.when(condition, then).when(~condition, otherwise), F.when(condition.isNull(), "input 'if' is not a bool")


def switch(value: Column, cases: list[tuple[str, Column]], default: Column | None = None) -> Column:
    """The last of equal cases wins; no match gives the default, else null."""
    out = None
    for key, action in dict(cases).items():
        out = F.when(value == key, action) if out is None else out.when(value == key, action)
    if out is None:
        return default if default is not None else F.lit(None)
    return out if default is None else out.otherwise(default)


def foreach(items: Column, do: Callable[[Column], Column], collect: bool = True) -> Column:
    """do of every item, in order."""
    done = F.transform(items, do)
    return done if collect else F.slice(done, 1, 0)


def repeat(times: Column, start: Column, do: Callable[[Column, Column], Column]) -> Column:
    """do(previous, i) for i from 0, ``times`` times; null for none. sequence(0, -1) would count down, hence the guard."""
    return F.when(times > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(times, F.lit(1)).cast("int") - 1), start, do))


def while_(start: Column, holds: Callable[[Column], Column], do: Callable[[Column], Column], limit: int) -> tuple[Column, Column]:
    """(output, error): do while the condition holds; after ``limit`` rounds that is an error."""
    step = lambda acc, _: F.struct(F.when(acc["go"], do(acc["v"])).otherwise(acc["v"]).alias("v"), (acc["go"] & holds(do(acc["v"]))).alias("go"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.struct(start.alias("v"), holds(start).alias("go")), step)
    return F.when(~end["go"], end["v"]), F.when(end["go"], "while limit exceeded")


def fail(inputs: dict[str, Column]) -> Column:
    """The error text."""
    if not inputs:
        return F.lit("fail function triggered")
    return F.coalesce(inputs["default"].cast("string"), F.lit("<nil>")) if "default" in inputs else F.lit("<nil>")


#: Units of a duration in milliseconds.
UNITS = {"h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1, "us": 1e-3, "ns": 1e-6}


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as 1h10m or 2m300ms; a bare number is milliseconds; null if it is neither."""
    part = r"([0-9]+(?:\.[0-9]+)?)(h|ms|us|ns|m|s)"
    unit = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(v))])
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(part), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(part), F.lit(2)).alias("u"))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["n"].cast("double") * F.element_at(unit, p["u"]))
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double")).when(text.rlike(f"^({part})+$"), total)


@query(INV + "SELECT invocation_id, priority AS output, NULL::VARCHAR AS nothing FROM inv")
def cf_noop(spark: SparkSession, d: str) -> DataFrame:
    return invocations(spark, d).select("invocation_id", noop({"other": F.col("status"), "default": F.col("priority")}).alias("output"), noop({}).alias("nothing"))


@query(INV + "SELECT invocation_id, '{\"a\":\"' || status || '\",\"default\":\"' || priority || '\"}' AS all_inputs, priority AS only_default FROM inv", name="compose")
def cf_compose(spark: SparkSession, d: str) -> DataFrame:
    return invocations(spark, d).select("invocation_id", compose({"a": F.col("status"), "default": F.col("priority")}).alias("all_inputs"), compose({"default": F.col("priority")}).alias("only_default"))


@query(INV + "SELECT invocation_id, CASE WHEN parent_id IS NOT NULL THEN 'parent' WHEN deadline IS NOT NULL THEN 'deadline' ELSE 'price' END AS chosen FROM inv")
def first_defined(spark: SparkSession, d: str) -> DataFrame:
    """The first input that is there."""
    return invocations(spark, d).select("invocation_id", F.coalesce(F.when(F.col("parent_id").isNotNull(), "parent"), F.when(F.col("deadline").isNotNull(), "deadline"), F.lit("price")).alias("chosen"))


@query(INV + "SELECT invocation_id, CASE WHEN invocation_id % 2 = 0 THEN CASE WHEN invocation_id % 4 = 0 THEN NULL ELSE priority END ELSE status END AS default_value FROM inv")
def default_input(spark: SparkSession, d: str) -> DataFrame:
    """The body stands in for a default that is missing, not for one that is null."""
    key = F.col("invocation_id")
    given = F.when(key % 2 == 0, F.create_map(F.lit("default"), F.when(key % 4 != 0, F.col("priority")), F.lit("body"), F.col("status"))).otherwise(F.create_map(F.lit("body"), F.col("status")))
    m = F.col("inputs")
    return invocations(spark, d).select("invocation_id", given.alias("inputs")).select("invocation_id", F.when(F.map_contains_key(m, "default"), F.try_element_at(m, F.lit("default"))).otherwise(F.try_element_at(m, F.lit("body"))).alias("default_value"))


@query(INV + "SELECT invocation_id, CASE WHEN deadline IS NULL THEN NULL WHEN price > 250000 THEN 'large' ELSE 'small' END AS output, CASE WHEN deadline IS NULL THEN 'input ''if'' is not a bool' END AS error FROM inv")
def cf_if(spark: SparkSession, d: str) -> DataFrame:
    out, error = if_(F.when(F.col("deadline").isNotNull(), F.col("price") > 250000), F.lit("large"), F.lit("small"))
    return invocations(spark, d).select("invocation_id", out.alias("output"), error.alias("error"))


@query(INV + "SELECT invocation_id, CASE priority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'today' ELSE 'later' END AS output, CASE priority WHEN '3-MEDIUM' THEN 'm' END AS no_default FROM inv")
def cf_switch(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("priority")
    return invocations(spark, d).select("invocation_id", switch(p, [("1-URGENT", F.lit("never")), ("2-HIGH", F.lit("today")), ("1-URGENT", F.lit("now"))], F.lit("later")).alias("output"), switch(p, [("3-MEDIUM", F.lit("m"))]).alias("no_default"))


def foreach_after(items: Column, start: Column, do: Callable[[Column, Column], Column]) -> Column:
    """do(previous, item) of every item, one after the other; the outputs in order."""
    return F.slice(F.aggregate(items, F.array(start), lambda done, x: F.concat(done, F.array(do(F.element_at(done, -1), x)))), 2, F.greatest(F.size(items), F.lit(1)))


@query(INV + """, i AS (SELECT invocation_id, CASE WHEN invocation_id % 6 = 0 THEN []::BIGINT[] ELSE range(1, invocation_id % 6 + 1) END AS l FROM inv)
SELECT invocation_id, array_to_string(list_transform(l, lambda x: x * 10), ',') AS tens, array_to_string(list_transform(l, lambda x: x * (x + 1) // 2), ',') AS sums, 0 AS uncollected FROM i""")
def cf_foreach(spark: SparkSession, d: str) -> DataFrame:
    """Each item by itself, one after the other (running sums), and without collecting."""
    n = F.col("invocation_id") % 6
    items = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    text = lambda l: F.array_join(l.cast("array<string>"), ",")
    sums = foreach_after(items, F.lit(0).cast("long"), lambda before, x: before + x)
    return invocations(spark, d).select("invocation_id", text(foreach(items, lambda x: x * 10)).alias("tens"), text(sums).alias("sums"), F.size(foreach(items, lambda x: x, collect=False)).alias("uncollected"))


@query(C + "SELECT invocation_id, string_agg((length(output) * 10)::VARCHAR, ',' ORDER BY task_id) AS outputs FROM chain GROUP BY invocation_id")
def foreach_collect(spark: SparkSession, d: str) -> DataFrame:
    """The outputs of a conversation's turns, in order; a group is one conversation."""
    pairs = F.sort_array(F.collect_list(F.struct("task_id", (F.length("output") * 10).cast("string").alias("o"))))
    return chain(spark, d).groupBy("invocation_id").agg(F.array_join(F.transform(pairs, lambda p: p["o"]), ",").alias("outputs"))


@query(
    "WITH RECURSIVE"
    + ORD
    + ", fib AS (SELECT 0 AS n, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT n + 1, b, a + b FROM fib WHERE n < 12) SELECT invocation_id, CASE WHEN invocation_id % 12 > 0 THEN fib.b END AS output FROM inv JOIN fib ON fib.n = invocation_id % 12"
)
def cf_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Fibonacci numbers by repetition of (a, b) -> (b, a + b)."""
    pair = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    end = repeat(F.col("invocation_id") % 12, pair, lambda p, _: F.struct(p["b"].alias("a"), (p["a"] + p["b"]).alias("b")))
    return invocations(spark, d).select("invocation_id", end["b"].alias("output"))


@query(INV + "SELECT invocation_id, CASE WHEN invocation_id % 15 <= 10 THEN invocation_id % 15 END AS output, CASE WHEN invocation_id % 15 > 10 THEN 'while limit exceeded' END AS error FROM inv")
def cf_while(spark: SparkSession, d: str) -> DataFrame:
    """Count up to a number, in at most 10 rounds."""
    goal = F.col("invocation_id") % 15
    out, error = while_(F.lit(0).cast("long"), lambda v: v < goal, lambda v: v + 1, 10)
    return invocations(spark, d).select("invocation_id", out.alias("output"), error.alias("error"))


@query(INV + "SELECT invocation_id, 'fail function triggered' AS no_input, status AS with_default, '<nil>' AS without_default FROM inv")
def cf_fail(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return invocations(spark, d).select("invocation_id", fail({}).alias("no_input"), fail({"default": s}).alias("with_default"), fail({"other": s}).alias("without_default"))


@query(INV + """SELECT invocation_id, [invocation_id % 24 || 'h' || invocation_id % 60 || 'm', invocation_id % 9 || 'm300ms', invocation_id % 5000 || 'ms', '' || invocation_id % 5000, invocation_id % 60 || '.5s', 'soon', ''][invocation_id % 7 + 1] AS text,
  [invocation_id % 24 * 3600000 + invocation_id % 60 * 60000, invocation_id % 9 * 60000 + 300, invocation_id % 5000, invocation_id % 5000, invocation_id % 60 * 1000 + 500, NULL, NULL][invocation_id % 7 + 1]::DOUBLE AS ms FROM inv""")
def cf_sleep_duration(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("invocation_id")
    forms = [F.format_string("%dh%dm", i % 24, i % 60), F.format_string("%dm300ms", i % 9), F.format_string("%dms", i % 5000), (i % 5000).cast("string"), F.format_string("%d.5s", i % 60), F.lit("soon"), F.lit("")]
    text = F.element_at(F.array(*forms), (i % 7 + 1).cast("int"))
    return invocations(spark, d).select("invocation_id", text.alias("text"), duration_ms(text).alias("ms"))


@query(INV + "SELECT invocation_id, round(price * 2, 4) AS doubled, upper(status) || '!' AS shouted, length(priority) < 6 AS short FROM inv")
def cf_javascript(spark: SparkSession, d: str) -> DataFrame:
    """What scripts in workflows do, as columns: arithmetic in doubles, case, length."""
    return invocations(spark, d).select("invocation_id", F.round(F.col("price") * 2, 4).alias("doubled"), F.concat(F.upper("status"), F.lit("!")).alias("shouted"), (F.length("priority") < 6).alias("short"))


#: The kinds that count as numbers, and those whose value is itself dataflow.
NUMBERS = ("float64", "float32", "int32", "int64", "uint32", "uint64")
FLOWS = ("task", "workflow", "flow")


def as_long(kind: Column, text: Column) -> Column:
    """A number truncated toward zero; null for any other kind, even for text that looks like a number."""
    return F.when(kind.isin(*NUMBERS), text.try_cast("double").cast("long"))


def as_double(kind: Column, text: Column) -> Column:
    return F.when(kind.isin(*NUMBERS), text.try_cast("double"))


KINDS = "WITH k AS (SELECT event_id, ['float64', 'int64', 'string', 'bool', 'task', 'workflow', 'nil'][event_id % 7 + 1] AS kind, ['' || value, '' || event_id, '' || event_id, 'true', '{}', '{}', NULL][event_id % 7 + 1] AS text FROM events)"


def kinds(spark: SparkSession, d: str) -> DataFrame:
    """event_id, kind, text: values of several kinds."""
    e, v = F.col("event_id").cast("string"), F.col("value").cast("string")
    at = lambda *c: F.element_at(F.array(*c), (F.col("event_id") % 7 + 1).cast("int"))
    kind = at(*map(F.lit, ["float64", "int64", "string", "bool", "task", "workflow", "nil"]))
    return table(spark, d, "events").select("event_id", kind.alias("kind"), at(v, e, e, F.lit("true"), F.lit("{}"), F.lit("{}"), F.lit(None)).alias("text"))


@query(KINDS + " SELECT event_id, kind, CASE WHEN kind IN ('float64', 'int64') THEN CAST(trunc(try_cast(text AS DOUBLE)) AS BIGINT) END AS as_int, CASE WHEN kind IN ('float64', 'int64') THEN try_cast(text AS DOUBLE) END AS as_float, CASE WHEN kind = 'string' THEN NULL::BIGINT END AS from_text FROM k")
def numeric_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """Doubles truncate toward zero, integers widen, text is refused."""
    k, t = F.col("kind"), F.col("text")
    return kinds(spark, d).select("event_id", "kind", as_long(k, t).alias("as_int"), as_double(k, t).alias("as_float"), F.when(k == "string", as_long(k, t)).alias("from_text"))


def input_error(key: str, kind: Column, *allowed: str) -> Column:
    """What is wrong with an input of a kind (null: it isn't there); null if nothing is."""
    return F.when(kind.isNull(), f"input '{key}' is not set").when(~kind.isin(*allowed), F.concat(F.lit(f"input '{key}' is a "), kind, F.lit(f", not one of {', '.join(allowed)}")))


@query(KINDS + """, g AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN kind END AS kind FROM k)
SELECT event_id, CASE WHEN kind IS NULL THEN 'input ''do'' is not set' WHEN kind NOT IN ('task', 'workflow') THEN 'input ''do'' is a ' || kind || ', not one of task, workflow' END AS do_error, CASE WHEN kind IS NULL THEN 'input ''times'' is not set' WHEN kind NOT IN ('int64', 'float64') THEN 'input ''times'' is a ' || kind || ', not one of float64, int64' END AS times_error FROM g""")
def input_check(spark: SparkSession, d: str) -> DataFrame:
    """Required inputs and their kinds: an error tells what is wrong."""
    kind = F.when(F.col("event_id") % 11 > 0, F.col("kind"))
    return kinds(spark, d).select("event_id", input_error("do", kind, "task", "workflow").alias("do_error"), input_error("times", kind, "float64", "int64").alias("times_error"))


@query(KINDS + " SELECT event_id, kind = 'task' OR kind = 'workflow' AS control_flow FROM k")
def control_flow_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether a value is dataflow that is still to be run."""
    return kinds(spark, d).select("event_id", F.col("kind").isin(*FLOWS).alias("control_flow"))


def resolved_inputs(df: DataFrame, inputs: dict[str, tuple[int, Callable[[dict[str, Column]], Column]]]) -> DataFrame:
    """df with a column for each input {name: (priority, of)}: by falling priority, then name; each sees those before it."""
    for name in sorted(inputs, key=lambda n: (-inputs[n][0], n)):
        df = df.withColumn(name, inputs[name][1]({n: F.col(n) for n in inputs if n in df.columns}))
    return df


@query(INV + "SELECT invocation_id, price * 2 AS item, 'x' || invocation_id AS label, 'x' || invocation_id || ':' || status AS text, false AS early FROM inv")
def input_order(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of one task: those of lower priority see those of higher ones, never the other way."""
    inputs = {
        "text": (0, lambda seen: F.concat(seen["label"], F.lit(":"), F.col("status"))),
        "label": (5, lambda seen: F.concat(F.lit("x"), F.col("invocation_id").cast("string"))),
        "item": (1000, lambda seen: F.col("price") * 2),
        "early": (1000, lambda seen: F.lit("label" in seen or "text" in seen)),
    }
    return resolved_inputs(invocations(spark, d).select("invocation_id", "price", "status"), inputs).select("invocation_id", *inputs)


@query("SELECT event_id, CAST(event_id % 12 AS INTEGER) AS attempt, CAST(100 * pow(2, event_id % 12) AS BIGINT) AS wait_ms, CAST(100 * (pow(2, event_id % 12 + 1) - 1) AS BIGINT) AS waited_ms FROM events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Of twelve attempts the one that each event is: the wait after it is 2^i times 100 ms, and all waits so far."""
    i = (F.col("event_id") % 12).cast("int")
    all_ = F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda acc, n: acc + F.lit(100) * F.pow(F.lit(2), n).cast("long"))
    return table(spark, d, "events").select("event_id", i.alias("attempt"), (100 * F.pow(F.lit(2), i)).cast("long").alias("wait_ms"), all_.alias("waited_ms"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, length(text) - 3) || '...' ELSE text END AS shown FROM documents")
def truncate_marker(spark: SparkSession, d: str) -> DataFrame:
    """A text over 80 characters loses its last three to a marker (as many as the marker has)."""
    n = F.length("text")
    return table(spark, d, "documents").select("doc_id", F.when(n > 80, F.concat(F.expr("left(text, length(text) - 3)"), F.lit("..."))).otherwise(F.col("text")).alias("shown"))


def is_expression(text: Column) -> Column:
    """A string in braces on one line is an expression."""
    return text.rlike(r"^\{(.*)\}$")


@query("SELECT event_id, regexp_matches(props, '^\\{(.*)\\}$') AS is_expression, regexp_replace(props, '^\\{(.*)\\}$', '\\1') AS body, regexp_matches(event_type, '^\\{(.*)\\}$') AS plain FROM events")
def expression_detect(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return table(spark, d, "events").select("event_id", is_expression(p).alias("is_expression"), F.regexp_replace(p, r"^\{(.*)\}$", "$1").alias("body"), is_expression(F.col("event_type")).alias("plain"))


def truthy(c: Column, kind: str) -> Column:
    """Null, false, 0, NaN and the empty string are not."""
    test = {"bool": c, "string": c != "", "number": (c != 0) & ~F.isnan(c.cast("double"))}[kind]
    return F.coalesce(test, F.lit(False))


@query(INV + "SELECT invocation_id, CASE WHEN coalesce(parent_id, 0) <> 0 THEN parent_id ELSE invocation_id END AS parent_or_self FROM inv")
def expr_or_default(spark: SparkSession, d: str) -> DataFrame:
    """a || b: the first operand if it is truthy."""
    p = F.col("parent_id")
    return invocations(spark, d).select("invocation_id", F.when(truthy(p, "number"), p).otherwise(F.col("invocation_id")).alias("parent_or_self"))


@query("SELECT event_id, event_id % 3 <> 0 AS number, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END <> '' AS string, NOT (event_id % 2 = 0) AS negated FROM events")
def expr_truthiness(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 5 == 0, "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", truthy(e % 3, "number").alias("number"), truthy(text, "string").alias("string"), (~truthy(e % 2 == 0, "bool")).alias("negated"))


@query(INV + "SELECT o_custkey, invocation_id, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(try_cast(left(priority, 1) AS INTEGER), 0) DESC, invocation_id) AS turn FROM inv")
def priority_order(spark: SparkSession, d: str) -> DataFrame:
    """A customer's invocations by falling priority; one that is no number counts as 0; ties by key."""
    p = F.coalesce(F.left("priority", F.lit(1)).try_cast("int"), F.lit(0))
    return invocations(spark, d).select("o_custkey", "invocation_id", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(p), "invocation_id")).cast("long").alias("turn"))


def js_substring(text: Column, a: Column, b: Column) -> Column:
    """Characters from a to b, counted from 0; bounds are clamped and swapped if need be."""
    low, high = (F.least(F.greatest(x, F.lit(0)), F.length(text)) for x in (a, b))
    return F.substring(text, F.least(low, high) + 1, F.greatest(low, high) - F.least(low, high))


@query(INV + "SELECT invocation_id, substr(priority, 3, 4) AS part, strpos(priority, '-') - 1 AS dash, substr(priority, 1, 2) AS swapped, trim('  ' || status || ' ') AS trimmed, priority || ' ' || status AS joined FROM inv")
def expr_strings(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("priority")
    at = lambda a, b: js_substring(p, F.lit(a), F.lit(b))
    return invocations(spark, d).select("invocation_id", at(2, 6).alias("part"), (F.instr(p, "-") - 1).cast("long").alias("dash"), at(2, -5).alias("swapped"), F.trim(F.concat(F.lit("  "), F.col("status"), F.lit(" "))).alias("trimmed"), F.concat(p, F.lit(" "), F.col("status")).alias("joined"))


@query(INV + "SELECT invocation_id, xor(invocation_id::INTEGER, 5)::BIGINT AS xored, invocation_id / 4.0::DOUBLE AS quotient, CASE WHEN invocation_id % 7 = 0 THEN NULL ELSE 100.0::DOUBLE / (invocation_id % 7) END AS guarded FROM inv")
def expr_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Arithmetic in doubles; a division by zero is a null, not a failed job."""
    i = F.col("invocation_id")
    return invocations(spark, d).select("invocation_id", i.bitwiseXOR(F.lit(5)).alias("xored"), (i / 4).alias("quotient"), F.try_divide(F.lit(100.0), i % 7).alias("guarded"))


@query(INV + "SELECT invocation_id, 'price=' || CAST(CAST(price AS BIGINT) AS VARCHAR) || ';status=' || status AS entries FROM (SELECT invocation_id, floor(price) AS price, status FROM inv)")
def struct_to_map(spark: SparkSession, d: str) -> DataFrame:
    """A struct's fields as a map, through JSON."""
    s = F.struct(F.floor("price").cast("string").alias("price"), "status")
    m = F.from_json(F.to_json(s), "map<string,string>")
    return invocations(spark, d).select("invocation_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("entries"))


# Values as scripts see them.


def script_number(x: Column) -> Column:
    """A double as scripts write it: whole numbers without a point, exponents from 1e21 on and below 1e-6."""
    s = x.cast("double").cast("string")
    sign, exponent = F.when(s.startswith("-"), "-").otherwise(""), F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    head = F.regexp_extract(s, r"^-?([0-9])\.", 1)
    tail = F.regexp_replace(F.regexp_extract(s, r"\.([0-9]+)", 1), "0+$", "")
    digits = F.concat(head, tail)
    large = F.when(F.length(tail) <= exponent, F.rpad(digits, exponent + 1, "0")).otherwise(F.concat(F.left(digits, exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(head, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.when(exponent > 0, "e+").otherwise("e"), exponent.cast("string"))
    spread = F.when((exponent >= 0) & (exponent < 21), large).when((exponent < 0) & (exponent >= -6), small).otherwise(power)
    return F.when(exponent.isNull(), F.regexp_replace(F.regexp_replace(s, r"\.0$", ""), "^-0$", "0")).otherwise(F.concat(sign, spread))


def script_text(x: Column, kind: str) -> Column:
    """A value as text; what isn't there is 'undefined'."""
    made = {"number": script_number(x), "bool": x.cast("string"), "string": x}[kind]
    return F.coalesce(made, F.lit("undefined"))


def int32(x: Column) -> Column:
    """A whole number wrapped to 32 bits with sign."""
    return F.pmod(x.cast("long") + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)


def utf16_length(text: Column) -> Column:
    """Characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def loosely_equal(number: Column, text: Column) -> Column:
    """number == text: the text counts as the number it spells, blank text as 0, other text as none."""
    spelled = F.when(F.trim(text) == "", 0.0).otherwise(F.trim(text).try_cast("double"))
    return F.coalesce(number.cast("double") == spelled, F.lit(False))


@query(INV + "SELECT invocation_id, regexp_replace(CAST(price * 1000 AS VARCHAR), '\\.0$', '') AS number, CASE WHEN parent_id IS NULL THEN 'undefined' ELSE CAST(parent_id AS VARCHAR) END AS missing, CAST(price > 200000 AS VARCHAR) AS flag, 'n' || regexp_replace(CAST(price AS VARCHAR), '\\.0$', '') AS joined FROM (SELECT * REPLACE (round(price, 0) AS price) FROM inv)")
def expr_string_of(spark: SparkSession, d: str) -> DataFrame:
    """String(x), and text + number."""
    p = F.round("price", 0)
    return invocations(spark, d).select("invocation_id", script_text(p * 1000, "number").alias("number"), script_text(F.col("parent_id"), "number").alias("missing"), script_text(p > 200000, "bool").alias("flag"), F.concat(F.lit("n"), script_number(p)).alias("joined"))


@query(INV + "SELECT invocation_id, xor((invocation_id * 1000003 + 2147483648) % 4294967296 - 2147483648, 5::BIGINT) AS xored, invocation_id % 10 = 7 OR invocation_id % 10 = 0 AS equal FROM inv")
def expr_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Bits are of 32-bit numbers, and == takes text for the number it spells."""
    i = F.col("invocation_id")
    text = F.when(i % 10 == 7, F.concat(F.lit(" "), i.cast("string"), F.lit(" "))).when(i % 10 == 0, " ").otherwise("no number")
    number = F.when(i % 10 == 0, 0).otherwise(i)
    return invocations(spark, d).select("invocation_id", int32(i * 1000003).bitwiseXOR(F.lit(5).cast("long")).alias("xored"), loosely_equal(number, text).alias("equal"))


@query("SELECT doc_id, (length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INTEGER AS units FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(128512) ELSE '' END AS t FROM documents)")
def expr_length(spark: SparkSession, d: str) -> DataFrame:
    """The length of texts as scripts count it, some with an emoji more."""
    t = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "\U0001f600").otherwise(""))
    return table(spark, d, "documents").select("doc_id", utf16_length(t).alias("units"))
