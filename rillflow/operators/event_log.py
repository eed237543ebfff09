"""Queries over the event log: keys, filters, labels, counts and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.log import EV, TERMINAL, events, order, table


def stream_key() -> Column:
    """An event is kept under its parent's key if it has a parent, else under its own aggregate's."""
    return F.concat_ws("/", F.coalesce("parent_type", "aggregate_type"), F.coalesce("parent_id", "aggregate_id"))


KEYED = "WITH" + EV + ", keyed AS (SELECT *, coalesce(parent_type, aggregate_type) || '/' || coalesce(parent_id, aggregate_id) AS stream_key FROM ev) "


@query(KEYED + "SELECT event_id, stream_key FROM keyed")
def event_stream_key(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", stream_key().alias("stream_key"))


@query(KEYED + "SELECT event_id, event_type, ts FROM keyed WHERE stream_key = 'invocation/7'")
def events_for_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A key's events in append order."""
    own = events(spark, d).filter((F.coalesce("parent_type", "aggregate_type") == "invocation") & (F.coalesce("parent_id", "aggregate_id") == "7"))
    return own.select("event_id", "event_type", "ts").orderBy("ts", "event_id")


@query(KEYED + "SELECT stream_key FROM keyed GROUP BY stream_key HAVING arg_max(event_type, (ts, event_id)) NOT IN ('InvocationCompleted')")
def active_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose last event is not terminal."""
    last = events(spark, d).groupBy(stream_key().alias("stream_key")).agg(F.max_by("event_type", order()).alias("last"))
    return last.filter(~F.col("last").isin(*TERMINAL)).select("stream_key")


@query("SELECT event_id, ts FROM events WHERE event_id BETWEEN 100 AND 400")
def seq_range(spark: SparkSession, d: str) -> DataFrame:
    """Events of an inclusive range of sequence numbers; the filter reaches the scan."""
    return between(events(spark, d), 100, 400).select("event_id", "ts")


def between(ev: DataFrame, first: int, last: int) -> DataFrame:
    """0 leaves that end open."""
    out = ev.filter(F.col("event_id") >= first) if first else ev
    return out.filter(F.col("event_id") <= last) if last else out


def subject_pattern(subject: str) -> str:
    """A regular expression for a subject: * is one segment, a final > is one or more."""
    parts = ["[^.]+" if p == "*" else ".+" if p == ">" else "\\Q" + p + "\\E" for p in subject.split(".")]
    return "^" + "\\.".join(parts) + "$"


SUBJECTS = "WITH" + EV + ", subjects AS (SELECT event_id, 'invocation.' || user_id::VARCHAR || '.' || event_type AS subject FROM ev) "


def subject() -> Column:
    return F.concat_ws(".", F.lit("invocation"), F.col("user_id").cast("string"), F.col("event_type"))


@query(SUBJECTS + "SELECT event_id, subject, regexp_matches(subject, '^invocation\\.[^.]+\\.TaskFailed$') AS one_segment, regexp_matches(subject, '^invocation\\.7\\..+$') AS rest FROM subjects WHERE regexp_matches(subject, '^invocation\\.[^.]+\\.TaskFailed$') OR regexp_matches(subject, '^invocation\\.7\\..+$')")
def subject_match(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).select("event_id", subject().alias("subject"))
    one, rest = F.col("subject").rlike(subject_pattern("invocation.*.TaskFailed")), F.col("subject").rlike(subject_pattern("invocation.7.>"))
    return s.select("*", one.alias("one_segment"), rest.alias("rest")).filter("one_segment OR rest")


@query(SUBJECTS + "SELECT subject, count(*) AS n FROM subjects GROUP BY subject")
def subject_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(subject().alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + EV + " SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def event_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + EV + " SELECT event_id, event_type FROM ev WHERE event_type IN ('InvocationCompleted', 'InvocationCanceled', 'InvocationFailed', 'WorkflowDeleted')")
def terminal_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter(F.col("event_type").isin(*TERMINAL)).select("event_id", "event_type")


@query("""WITH bad AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts FROM events)
SELECT event_id, concat_ws(',', CASE WHEN event_type = '' THEN 'no type' END, CASE WHEN id IS NULL THEN 'no aggregate id' END, CASE WHEN ts IS NULL THEN 'no timestamp' END) AS errors FROM bad""")
def event_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every rule an event breaks, on the log with some fields blanked."""
    e = F.col("event_id")
    bad = events(spark, d).select("event_id", F.when(e % 7 == 0, "").otherwise(F.col("event_type")).alias("event_type"), F.when(e % 5 == 0, None).otherwise(F.col("user_id")).alias("id"), F.when(e % 11 == 0, None).otherwise(F.col("ts")).alias("ts"))
    rules = [(F.col("event_type") == "", "no type"), (F.col("id").isNull(), "no aggregate id"), (F.col("ts").isNull(), "no timestamp")]
    return bad.select("event_id", F.array_join(F.array_compact(F.array(*[F.when(c, m) for c, m in rules])), ",").alias("errors"))


# Label matchers: functions from the row's labels to a condition.


def label_is_in(key: str, *values: str) -> Column:
    """True if the label is one of the values; without values never."""
    return F.coalesce(F.col(key).isin(*values), F.lit(False)) if values else F.lit(False)


def label_all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def label_any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def labelled(ev: DataFrame) -> DataFrame:
    """The six labels of an event; empty where it has no parent."""
    empty = F.lit("")
    return ev.select("event_id", "aggregate_type", "aggregate_id", F.coalesce("parent_type", empty).alias("parent_type"), F.coalesce("parent_id", empty).alias("parent_id"), "event_type")


@query("WITH" + EV + " SELECT event_id, event_type IN ('TaskFailed', 'TaskSucceeded') AS matched, false AS matched_none, coalesce(parent_type, '') IN ('') AS no_parent FROM ev")
def label_in(spark: SparkSession, d: str) -> DataFrame:
    return labelled(events(spark, d)).select("event_id", label_is_in("event_type", "TaskFailed", "TaskSucceeded").alias("matched"), label_is_in("event_type").alias("matched_none"), label_is_in("parent_type", "").alias("no_parent"))


@query("WITH" + EV + " SELECT event_id, event_type, parent_id FROM ev WHERE event_type = 'TaskFailed' AND parent_id IN ('1', '2', '3')")
def label_and(spark: SparkSession, d: str) -> DataFrame:
    return labelled(events(spark, d)).filter(label_all(label_is_in("event_type", "TaskFailed"), label_is_in("parent_id", "1", "2", "3"))).select("event_id", "event_type", "parent_id")


@query("WITH" + EV + " SELECT event_id, event_type, coalesce(parent_id, '') AS parent_id FROM ev WHERE event_type = 'InvocationCompleted' OR parent_id IN ('1', '2', '3')")
def label_or(spark: SparkSession, d: str) -> DataFrame:
    return labelled(events(spark, d)).filter(label_any(label_is_in("event_type", "InvocationCompleted"), label_is_in("parent_id", "1", "2", "3"))).select("event_id", "event_type", "parent_id")


# Retention and order.


@query("SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def notification_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the state before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("before"))


STATES = "CASE last_value(CASE WHEN aggregate_type = 'invocation' THEN event_type END IGNORE NULLS) OVER {w} WHEN 'InvocationCompleted' THEN 'SUCCEEDED' WHEN 'InvocationCreated' THEN 'IN_PROGRESS' END"
PAYLOAD = "last_value(CASE WHEN event_type = 'InvocationCompleted' THEN value END IGNORE NULLS) OVER {w}"


@query("WITH" + EV + ", " + "s AS (SELECT user_id, event_id, " + ", ".join(f"{x.format(w=w)} AS {n}" for n, x, w in [("status_after", STATES, "upto"), ("status_before", STATES, "before"), ("output_after", PAYLOAD, "upto"), ("output_before", PAYLOAD, "before")]) + """ FROM ev
  WINDOW upto AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM s""")
def notification_states(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its invocation's state before and after it. A key's events are one window, as their order is the point."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    status = F.when(F.col("event_type") == "InvocationCompleted", "SUCCEEDED").when(F.col("aggregate_type") == "invocation", "IN_PROGRESS")
    output = F.when(F.col("event_type") == "InvocationCompleted", F.col("value"))
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    sets = {"status": status, "output": output}
    return events(spark, d).select("user_id", "event_id", *[F.last(c, ignorenulls=True).over(f).alias(f"{n}_{when}") for n, c in sets.items() for when, f in (("after", upto), ("before", before))])


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 10")
def events_offset(spark: SparkSession, d: str) -> DataFrame:
    """A stream's events from an offset on."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select("user_id", "event_id", F.row_number().over(w).alias("n")).filter("n > 10").drop("n")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 11")
def events_per_key_cap(spark: SparkSession, d: str) -> DataFrame:
    """A cap of 10 rejects an event when more than 10 are kept already, so 11 stay."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select("user_id", "event_id", F.row_number().over(w).alias("n")).filter("n <= 11").drop("n")


@query("WITH" + EV + " SELECT user_id, event_id, event_type, aggregate_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM ev")
def merged_event_history(spark: SparkSession, d: str) -> DataFrame:
    """An invocation's own events and those of its tasks, in one order."""
    both = events(spark, d).filter(F.col("aggregate_type").isin("invocation", "taskrun"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return both.select("user_id", "event_id", "event_type", "aggregate_type", F.row_number().over(w).cast("long").alias("position"))


LAST = "WITH" + EV + ", last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) = 'InvocationCompleted' AS done, max(ts) AS done_at FROM ev GROUP BY user_id) "


@query(LAST + "SELECT user_id, done FROM last WHERE NOT done UNION ALL SELECT user_id, done FROM (SELECT user_id, done, row_number() OVER (ORDER BY done_at DESC, user_id) AS n FROM last WHERE done) WHERE n <= 20")
def lru_retained(spark: SparkSession, d: str) -> DataFrame:
    """All active streams, and the 20 that completed last."""
    last = events(spark, d).groupBy("user_id").agg((F.max_by("event_type", order()) == "InvocationCompleted").alias("done"), F.max("ts").alias("at"))
    kept = last.filter("done").orderBy(F.desc("at"), "user_id").limit(20)
    return last.filter("NOT done").select("user_id", "done").unionByName(kept.select("user_id", "done"))


@query(LAST + ", n AS (SELECT count(*) FILTER (WHERE NOT done) AS active, count(*) AS keys FROM last) SELECT places, active, keys, greatest(least(places - active, keys - active), 0) AS kept, greatest(keys - active - greatest(places - active, 0), 0) AS evicted, CASE WHEN active >= places THEN 'event store overflow' END AS error FROM n, (SELECT unnest([10, 1000000]::BIGINT[]) AS places)")
def lru_overflow(spark: SparkSession, d: str) -> DataFrame:
    """What a store of so many keys does with a new one: completed streams make way, active ones never; all active is an error."""
    last = events(spark, d).groupBy("user_id").agg((F.max_by("event_type", order()) == "InvocationCompleted").alias("done"))
    n = last.agg(F.count_if(~F.col("done")).alias("active"), F.count(F.lit(1)).alias("keys")).withColumn("places", F.explode(F.array(*[F.lit(p).cast("long") for p in (10, 1_000_000)])))
    free, completed, none = F.greatest(F.col("places") - F.col("active"), F.lit(0)), F.col("keys") - F.col("active"), F.lit(0)
    return n.select("places", "active", "keys", F.least(free, completed).alias("kept"), F.greatest(completed - free, none).alias("evicted"), F.when(F.col("active") >= F.col("places"), "event store overflow").alias("error"))


@query("SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 25")
def lru_cache_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 25 entities used last."""
    return events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_used")).orderBy(F.desc("last_used"), "user_id").limit(25)


@query("SELECT user_id, count(*) AS evaluations, max(ts) AS last_evaluated FROM events GROUP BY user_id")
def eval_stats(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("evaluations"), F.max("ts").alias("last_evaluated"))


@query("WITH" + EV + " SELECT aggregate_type, count(*) AS events, count(DISTINCT aggregate_id) AS keys FROM ev GROUP BY aggregate_type")
def store_gauges(spark: SparkSession, d: str) -> DataFrame:
    """Two levels (per key, then per type), so that a type's keys are not gathered in one task."""
    per_key = events(spark, d).groupBy("aggregate_type", "aggregate_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("aggregate_type").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("keys"))


#: The quantiles that delay summaries report.
QUANTILES = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.999, 1.0]


@query("SELECT event_type, q, round(v, 6) AS delay FROM (SELECT event_type, unnest([" + ", ".join(map(str, QUANTILES)) + "]::DOUBLE[]) AS q, unnest(quantile_cont(value, [" + ", ".join(map(str, QUANTILES)) + "])) AS v FROM events GROUP BY event_type)")
def delay_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles; equal values are counted before the shuffle."""
    q = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(QUANTILES)).alias("v"))
    pairs = F.arrays_zip(F.lit(QUANTILES).alias("q"), F.col("v").alias("v"))
    return q.select("event_type", F.explode(pairs).alias("x")).select("event_type", F.col("x.q").alias("q"), F.round("x.v", 6).alias("delay"))


@query("WITH" + EV + " SELECT user_id, sum(CASE event_type WHEN 'TaskStarted' THEN 1 WHEN 'TaskSucceeded' THEN -1 WHEN 'TaskFailed' THEN -1 ELSE 0 END)::BIGINT AS in_flight FROM ev GROUP BY user_id")
def inflight_tasks(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "TaskStarted", 1).when(F.col("event_type").isin("TaskSucceeded", "TaskFailed"), -1).otherwise(0)
    return events(spark, d).groupBy("user_id").agg(F.sum(delta).alias("in_flight"))


@query("WITH" + EV + " SELECT event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 10")
def pubsub_drop(spark: SparkSession, d: str) -> DataFrame:
    """A full subscriber buffer of 10 drops what comes later. The smallest of each type are found before the shuffle."""
    ev = events(spark, d).select("event_type", "ts", "event_id")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return ev.withColumn("n", F.row_number().over(w)).filter("n <= 10").select("event_type", "event_id")


@query("SELECT props AS item, min(event_id) AS first_seq, arg_max(value, event_id) AS payload FROM events GROUP BY props")
def queue_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A queued item keeps its place; the payload is that of the latest."""
    return table(spark, d, "events").groupBy(F.col("props").alias("item")).agg(F.min("event_id").alias("first_seq"), F.max_by("value", "event_id").alias("payload"))


@query("SELECT props AS item, min(epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT)) AS ready_ms FROM events GROUP BY props")
def delay_queue_order(spark: SparkSession, d: str) -> DataFrame:
    """Of an item's duplicates the earliest is kept; items leave by that time."""
    ready = F.unix_millis(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000)
    return table(spark, d, "events").groupBy(F.col("props").alias("item")).agg(F.min(ready).alias("ready_ms"))


#: The transitions of a task.
TRANSITIONS = [("view", "click"), ("view", "error"), ("click", "view"), ("click", "purchase"), ("error", "view"), ("signup", "view"), ("purchase", "signup")]


@query("WITH legal(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TRANSITIONS) + """), pairs AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events)
SELECT event_id, pairs.a AS from_state, pairs.b AS to_state, legal.a IS NOT NULL AS legal FROM pairs LEFT JOIN legal ON pairs.a = legal.a AND pairs.b = legal.b WHERE pairs.a IS NOT NULL""")
def fsm_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive states of a stream against the transition table, which is broadcast (seven rows)."""
    legal = spark.createDataFrame(TRANSITIONS, "from_state string, to_state string").withColumn("ok", F.lit(True))
    pairs = notification_pairs(spark, d).filter("before IS NOT NULL").select("event_id", F.col("before").alias("from_state"), F.col("event_type").alias("to_state"))
    return pairs.join(F.broadcast(legal), ["from_state", "to_state"], "left").select("event_id", "from_state", "to_state", F.coalesce("ok", F.lit(False)).alias("legal"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def replay_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Only events after a subscriber's start notify it; the filter reaches the scan."""
    return table(spark, d, "events").filter(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("SELECT CAST(user_id % 4 AS BIGINT) AS queue, count(DISTINCT props) AS length, least(count(DISTINCT props), 50) AS accepted FROM events GROUP BY 1")
def queue_length(spark: SparkSession, d: str) -> DataFrame:
    """Distinct items that wait in each queue, and those that one of 50 places takes."""
    items = table(spark, d, "events").select((F.col("user_id") % 4).alias("queue"), "props").distinct()
    n = items.groupBy("queue").agg(F.count(F.lit(1)).alias("length"))
    return n.select("queue", "length", F.least("length", F.lit(50).cast("long")).alias("accepted"))


@query("WITH" + EV + " SELECT t.event_id, t.aggregate_id AS task_run_id, i.user_id AS invocation_id, i.created FROM ev t JOIN (SELECT user_id, min(ts) AS created FROM ev WHERE event_type = 'InvocationCreated' GROUP BY user_id) i ON t.parent_id = i.user_id::VARCHAR")
def task_event_parent_join(spark: SparkSession, d: str) -> DataFrame:
    """Task events with the invocation they fold into."""
    ev = events(spark, d)
    own = ev.filter(F.col("event_type") == "InvocationCreated").groupBy(F.col("user_id").alias("invocation_id")).agg(F.min("ts").alias("created"))
    tasks = ev.filter("parent_id IS NOT NULL").select("event_id", F.col("aggregate_id").alias("task_run_id"), "parent_id")
    return tasks.join(own, F.col("parent_id") == F.col("invocation_id").cast("string")).select("event_id", "task_run_id", "invocation_id", "created")


@query("WITH q AS (SELECT user_id % 4 AS queue, props, min(event_id) AS first FROM events GROUP BY ALL) SELECT queue, props AS item, row_number() OVER (PARTITION BY queue ORDER BY first) > 50 AS rejected FROM q")
def queue_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Which items a queue of 50 places takes and which it rejects: the first to come stand in it. The places are found before the shuffle."""
    items = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("queue"), F.col("props").alias("item")).agg(F.min("event_id").alias("first"))
    w = Window.partitionBy("queue").orderBy("first")
    last = items.withColumn("n", F.row_number().over(w)).filter("n <= 50").groupBy("queue").agg(F.max("first").alias("last"))
    return items.join(last, "queue").select("queue", "item", (F.col("first") > F.col("last")).alias("rejected"))


@query("WITH" + EV + " SELECT CASE CAST(props->>'$.k' AS INTEGER) % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'http' ELSE 'workflows' END AS runtime, count(*) FILTER (WHERE event_type = 'TaskStarted') AS resolved, count(*) FILTER (WHERE event_type <> 'TaskStarted') AS executed, count(*) FILTER (WHERE event_type = 'TaskFailed') AS failed FROM ev WHERE aggregate_type = 'taskrun' GROUP BY 1")
def runtime_counters(spark: SparkSession, d: str) -> DataFrame:
    """Functions resolved, executed and failed by the runtime that a task's number stands for."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    runtime = F.when(k == 0, "native").when(k == 1, "http").otherwise("workflows")
    t = F.col("event_type")
    return events(spark, d).filter("aggregate_type = 'taskrun'").groupBy(runtime.alias("runtime")).agg(F.count_if(t == "TaskStarted").alias("resolved"), F.count_if(t != "TaskStarted").alias("executed"), F.count_if(t == "TaskFailed").alias("failed"))


@query("WITH" + EV + ", runs AS (SELECT aggregate_id, parent_id, arg_max(event_type, (ts, event_id)) AS t FROM ev WHERE aggregate_type = 'taskrun' GROUP BY ALL) SELECT count(*) AS cached_runs, count(*) FILTER (WHERE t = 'TaskStarted') AS active_functions, count(DISTINCT parent_id) FILTER (WHERE t = 'TaskStarted') AS subscriptions FROM runs")
def activity_gauges(spark: SparkSession, d: str) -> DataFrame:
    """Runs that are cached, those still active, and the invocations that wait for one; counted per invocation, then in all."""
    runs = events(spark, d).filter("aggregate_type = 'taskrun'").groupBy("parent_id", "aggregate_id").agg(F.max_by("event_type", order()).alias("t"))
    each = runs.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == "TaskStarted").alias("active"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cached_runs"), F.coalesce(F.sum("active"), F.lit(0)).alias("active_functions"), F.count_if(F.col("active") > 0).alias("subscriptions"))


@query("WITH" + EV + ", e AS (SELECT user_id, event_type, ts, event_id FROM ev WHERE aggregate_type = 'invocation'), c AS (SELECT user_id, ts, event_id, ts + INTERVAL 10 MINUTE AS due FROM e WHERE event_type = 'InvocationCreated'), f AS (SELECT c.event_id, min(e.ts) AS ended FROM c LEFT JOIN e ON e.user_id = c.user_id AND e.event_type = 'InvocationCompleted' AND (e.ts, e.event_id) > (c.ts, c.event_id) GROUP BY c.event_id) SELECT c.event_id, CASE WHEN ended <= due THEN 'SUCCEEDED' ELSE 'ABORTED' END AS result, CASE WHEN ended <= due THEN ended ELSE due END AS returned_at FROM c JOIN f USING (event_id)")
def await_result(spark: SparkSession, d: str) -> DataFrame:
    """What a caller who waits for each invocation sees: its end, or at the deadline of ten minutes that it was cancelled."""
    own = events(spark, d).filter("aggregate_type = 'invocation'")
    onward = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    ended = F.min(F.when(F.col("event_type") == "InvocationCompleted", F.col("ts"))).over(onward)
    waits = own.select("event_id", "event_type", "ts", ended.alias("ended")).filter("event_type = 'InvocationCreated'").withColumn("due", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    in_time = F.coalesce(F.col("ended") <= F.col("due"), F.lit(False))
    return waits.select("event_id", F.when(in_time, "SUCCEEDED").otherwise("ABORTED").alias("result"), F.when(in_time, F.col("ended")).otherwise(F.col("due")).alias("returned_at"))
