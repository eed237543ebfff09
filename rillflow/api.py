"""Workflows by id, and their invocations kept as an append-only table of events: invoke, add tasks, cancel, list, get, history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.workflow import Task, Workflow
from .sources.shared import stored

SCHEMA = "event_type string, invocation_id string, workflow_id string, parent_id string, ts timestamp, seq bigint, data string"
ENDS = {"InvocationCompleted": "SUCCEEDED", "InvocationFailed": "FAILED", "InvocationCanceled": "ABORTED"}


class Workflows:
    """Workflows by id: create, validate, get, list, delete. They are plans, so they live as long as the session's program."""

    def __init__(self) -> None:
        self._known: dict[str, Workflow] = {}

    @staticmethod
    def validate(tasks: Mapping[str, Task], output: str, api_version: str = "v1") -> list[str]:
        """Every rule that a specification breaks; none if it is right."""
        try:
            Workflow(tasks, output, api_version)
        except ValueError as e:
            return str(e).split("; ")
        return []

    def create(self, workflow_id: str, tasks: Mapping[str, Task], output: str, api_version: str = "v1") -> Workflow:
        """The workflow, which replaces one of the same id; a ValueError tells every rule it breaks."""
        if not workflow_id:
            raise ValueError("no workflow id")
        self._known[workflow_id] = Workflow(tasks, output, api_version)
        return self._known[workflow_id]

    def get(self, workflow_id: str) -> Workflow:
        """A KeyError if there is none."""
        return self._known[workflow_id]

    def list(self) -> list[str]:
        return sorted(self._known)

    def delete(self, workflow_id: str) -> None:
        del self._known[workflow_id]


class Invocations:
    """Appends are Spark writes to one folder; state is a fold that Spark computes when asked."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, events: DataFrame) -> None:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        events.select(*names).write.mode("append").partitionBy("event_type").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def invoke(self, workflow_id: str, workflow: Workflow, invocations: DataFrame) -> DataFrame:
        """Run the workflow once on rows with invocation_id and inputs, record creation and end of each, and return what was stored."""
        done = stored(workflow.run(invocations), "invoked")
        base = done.select(F.lit(workflow_id).alias("workflow_id"), F.lit(None).cast("string").alias("parent_id"), F.current_timestamp().alias("ts"), F.col("invocation_id").cast("string").alias("invocation_id"), "status", F.to_json(F.struct("output", "error")).alias("data"))
        kind = F.when(F.col("status") == "SUCCEEDED", "InvocationCompleted").otherwise("InvocationFailed")
        both = base.select(F.explode(F.array(F.struct(F.lit("InvocationCreated").alias("event_type"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("d")), F.struct(kind.alias("event_type"), F.lit(1).cast("long").alias("seq"), F.col("data").alias("d")))).alias("e"), "*")
        self.append(both.select("e.event_type", "invocation_id", "workflow_id", "parent_id", "ts", "e.seq", F.col("e.d").alias("data")))
        return done

    def add_task(self, tasks: DataFrame) -> None:
        """tasks: invocation_id, task_id and spec (JSON) of dynamic tasks; the job fails at an empty id, and nothing is recorded."""
        valid = F.when((F.coalesce(F.col("invocation_id"), F.lit("")) != "") & (F.coalesce(F.col("task_id"), F.lit("")) != ""), True).otherwise(F.raise_error(F.lit("no invocation or task id")).cast("boolean"))
        none = F.lit(None).cast("string")
        self.append(tasks.filter(valid).select(F.lit("InvocationTaskAdded").alias("event_type"), "invocation_id", none.alias("workflow_id"), none.alias("parent_id"), F.current_timestamp().alias("ts"), F.lit(1).cast("long").alias("seq"), F.to_json(F.struct("task_id", "spec")).alias("data")))

    def tasks(self, invocation_id: str) -> DataFrame:
        """invocation_id, task_id, spec: an invocation's dynamic tasks, of each id the one added last."""
        added = self.events().filter((F.col("invocation_id") == invocation_id) & (F.col("event_type") == "InvocationTaskAdded"))
        of = lambda k: F.get_json_object("data", f"$.{k}")
        return added.groupBy("invocation_id", of("task_id").alias("task_id")).agg(F.max_by(of("spec"), F.struct("ts", "seq")).alias("spec"))

    def validate(self, invocations: DataFrame) -> DataFrame:
        """invocation_id and what is wrong with it (null: nothing), for rows with invocation_id and workflow_id."""
        error = F.when(F.coalesce(F.col("invocation_id").cast("string"), F.lit("")) == "", "no invocation id").when(F.coalesce("workflow_id", F.lit("")) == "", "no workflow id")
        return invocations.select("invocation_id", error.alias("error"))

    def cancel(self, invocation_ids: DataFrame) -> None:
        """invocation_ids: a column invocation_id; the job fails at an empty one, and nothing is recorded."""
        valid = F.when(F.coalesce(F.col("invocation_id"), F.lit("")) != "", True).otherwise(F.raise_error(F.lit("no invocation id")).cast("boolean"))
        now = invocation_ids.filter(valid).select(F.lit("InvocationCanceled").alias("event_type"), "invocation_id", F.lit(None).cast("string").alias("workflow_id"), F.lit(None).cast("string").alias("parent_id"), F.current_timestamp().alias("ts"), F.lit(2).cast("long").alias("seq"), F.lit('{"error":"workflow invocation was canceled"}').alias("data"))
        self.append(now)

    def list(self, *workflows: str) -> DataFrame:
        """State of every invocation; of some workflows if any are named."""
        at, ended = F.struct("ts", "seq"), F.col("event_type").isin(*ENDS)
        to = F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv])
        state = self.events().groupBy("invocation_id").agg(F.max_by("workflow_id", F.when(F.col("workflow_id").isNotNull(), at)).alias("workflow_id"), F.max_by("event_type", F.when(ended, at)).alias("end"), F.max_by("data", F.when(ended, at)).alias("data"), F.max("ts").alias("updated_at"))
        out = state.select("invocation_id", "workflow_id", F.coalesce(F.try_element_at(to, F.col("end")), F.lit("IN_PROGRESS")).alias("status"), "data", "updated_at")
        return out.filter(F.col("workflow_id").isin(*workflows)) if workflows else out

    def get(self, invocation_id: str) -> DataFrame:
        return self.list().filter(F.col("invocation_id") == invocation_id)

    def history(self, invocation_id: str) -> DataFrame:
        return self.events().filter(F.col("invocation_id") == invocation_id).orderBy("ts", "seq")
