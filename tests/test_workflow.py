"""Workflows end to end: golden cases of outputs, failures, overrides, nesting and loops."""

import pytest
from pyspark.sql import functions as F

from rillflow.api import Invocations, Workflows
from rillflow.functions import control, web
from rillflow.operators import folds
from rillflow.plans.workflow import Flow, Task, Workflow
from rillflow.sources import specs
from rillflow.streaming import fold


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.createDataFrame([("1", "foo", 5), ("2", "bar", 50)], "invocation_id string, default string, n int")


def outputs(df):
    return [tuple(r) for r in df.orderBy("invocation_id").select("status", "output", "error").collect()]


def test_upper_then_pass_on(inputs):
    w = Workflow({"first": Task(lambda s: F.upper(s.param())), "last": Task(lambda s: s.output("first"), ("first",))}, "last")
    assert outputs(w.run(inputs)) == [("SUCCEEDED", "FOO", None), ("SUCCEEDED", "BAR", None)] and w.waves == {"first": 1, "last": 2}


def test_if_chooses_a_task(inputs):
    w = Workflow({"a": Task(lambda s: F.upper(s.param())), "b": Task(lambda s: control.if_(s.output("a") == "FOO", F.concat(F.lit("alternative: "), s.output("a")), s.output("a")), ("a",))}, "b")
    assert [o for _, o, _ in outputs(w.run(inputs))] == ["alternative: FOO", "BAR"]


def test_merge_and_overrides(inputs):
    tasks = {str(i): Task(lambda s, i=i: F.lit(str(i))) for i in range(1, 5)}
    w = Workflow({**tasks, "m": Task(lambda s: F.concat(*[s.output(str(i)) for i in range(1, 5)]), ("1", "2", "3", "4"))}, "m")
    assert outputs(w.run(inputs))[0] == ("SUCCEEDED", "1234", None)
    w = Workflow({"a": Task(lambda s: F.lit("actual"), override=lambda s: F.concat(F.lit("not "), s.output("a"))), "b": Task(lambda s: s.output("a"), ("a",))}, "b")
    assert outputs(w.run(inputs))[0][1] == "not actual"


def test_failure_stops_later_waves_only(inputs):
    w = Workflow({"ok": Task(lambda s: F.lit("x")), "bad": Task(lambda s: (s.param(), F.when(s.param() == "foo", control.fail({"default": F.lit("all has failed")})))), "late": Task(lambda s: F.lit("y"), ("ok",))}, "late")
    got = w.run(inputs).orderBy("invocation_id").collect()
    assert [(r.status, r.error, r.ok_status, r.bad_status, r.late_status) for r in got] == [("FAILED", "all has failed", "SUCCEEDED", "FAILED", "UNKNOWN"), ("SUCCEEDED", None, "SUCCEEDED", "SUCCEEDED", "SUCCEEDED")]


def test_loops_and_nesting(inputs):
    count = Workflow({"c": Task(lambda s: control.while_(F.lit(0), lambda v: v < s.param("n"), lambda v: v + 1, 10))}, "c")
    assert outputs(count.run(inputs)) == [("SUCCEEDED", 5, None), ("FAILED", None, "while limit exceeded")]
    inner = Workflow({"up": Task(lambda s: F.upper(s.param())), "out": Task(lambda s: F.concat(s.output("up"), F.lit("!")), ("up",))}, "out")
    outer = Workflow({"a": Task(lambda s: F.reverse(s.param())), **inner.as_task("call", lambda s: {"default": s.output("a")}, ("a",))}, "call")
    assert outputs(outer.run(inputs))[0] == ("SUCCEEDED", "OOF!", None)
    each = Workflow({"e": Task(lambda s: F.to_json(control.foreach(F.sequence(F.lit(1), s.param("n")), lambda x: x * 10)))}, "e")
    assert outputs(each.run(inputs))[0][1] == "[10,20,30,40,50]"


@pytest.mark.parametrize(
    ("change", "error"),
    [({"api_version": "nonExistent"}, "apiVersion"), ({"output": "x"}, "unknown output"), ({"tasks": {}}, "no tasks"), ({"m": ("gone",)}, "undefined gone"), ({"first": ("last",)}, "cycle")],
)
def test_validation(change, error):
    task = lambda *r: Task(lambda s: F.lit(1), r)
    tasks = {"first": task(*change.get("first", ())), "middle": task(*change.get("m", ("first",))), "last": task("middle")}
    with pytest.raises(ValueError, match=error):
        Workflow(change.get("tasks", tasks), change.get("output", "last"), change.get("api_version", "v1"))


def test_specs(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("output: b\ntasks:\n  a: {run: noop, inputs: hi}\n  b:\n    requires: [a]\n    inputs: {x: 1}\n  c:\n")
    (tmp_path / "b.json").write_text('{"output": "t", "tasks": {"t": {"run": "fail"}}}')
    (tmp_path / "c.yaml").write_text("tasks: [")
    got = {(r.path.rsplit("/", 1)[1], r.task_id): r for r in specs.tasks(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.yaml", "a"), ("a.yaml", "b"), ("b.json", "t"), ("c.yaml", None)}
    assert got["a.yaml", "a"].inputs == '{"default": "hi"}' and got["a.yaml", "b"].function_ref == "noop" and got["a.yaml", "b"].requires == ["a"] and got["a.yaml", "b"].is_output
    assert got["c.yaml", None].error


def test_invocations_api(spark, inputs, tmp_path):
    api = Invocations(spark, str(tmp_path / "events"))
    w = Workflow({"a": Task(lambda s: (s.param(), F.when(s.param() == "bar", F.lit("no"))))}, "a")
    done = api.invoke("wf", w, inputs)
    assert {r.status for r in done.collect()} == {"SUCCEEDED", "FAILED"}
    assert {(r.invocation_id, r.status) for r in api.list("wf").collect()} == {("1", "SUCCEEDED"), ("2", "FAILED")}
    with pytest.raises(Exception, match="no invocation id"):
        api.cancel(spark.createDataFrame([("",)], "invocation_id string"))
    api.cancel(spark.createDataFrame([("2",)], "invocation_id string"))
    assert api.get("2").first().status == "ABORTED" and api.list("other").count() == 0
    assert [r.event_type for r in api.history("2").collect()] == ["InvocationCreated", "InvocationFailed", "InvocationCanceled"]


def test_folds_of_all_event_types(spark):
    rows = [("a", "InvocationCreated", 1), ("a", "InvocationTaskAdded", 2), ("a", "InvocationFailed", 3), ("b", "InvocationCreated", 4), ("b", "InvocationCompleted", 5), ("b", "InvocationCreated", 6), ("b", "InvocationCanceled", 7)]
    runs = [("a/x", "TaskStarted", 1), ("a/x", "TaskSucceeded", 2), ("a/x", "TaskStarted", 3), ("a/y", "TaskStarted", 4), ("a/y", "TaskSkipped", 5), ("a/z", "TaskFailed", 6)]
    columns = "user_id string, event_type string, event_id long, ts long, aggregate_type string, aggregate_id string, value double, task_id string"
    ev = spark.createDataFrame([(i, t, n, n, "invocation", i, float(n), "t") for i, t, n in rows] + [(i[:1], t, n, n, "taskrun", i, float(n), None) for i, t, n in runs], columns)
    assert sorted(map(tuple, folds.invocation_state(ev).collect())) == [("a", "FAILED", None, 3.0, 1, 3), ("b", "ABORTED", None, 7.0, 0, 2)]
    assert sorted(map(tuple, folds.task_state(ev).collect())) == [("a/x", "IN_PROGRESS", None, None, 2), ("a/y", "SKIPPED", None, None, 3), ("a/z", "FAILED", None, 6.0, 1)]
    odd = ev.withColumn("event_type", F.lit("Odd")).unionAll(ev)
    with pytest.raises(Exception, match="unsupported event"):
        folds.task_state(odd).collect()


def test_a_task_may_return_dataflow(inputs):
    up = Workflow({"u": Task(lambda s: F.upper(s.param())), "out": Task(lambda s: F.concat(s.output("u"), F.lit("!")), ("u",))}, "out")
    bad = Workflow({"f": Task(lambda s: (F.lit("x"), F.lit("told so")))}, "f")
    deep = Workflow({"d": Task(lambda s: Flow(((s.param() == "foo", up),)))}, "d")
    choose = lambda a, b, rest=None: Workflow({"first": Task(lambda s: s.param()), "c": Task(lambda s: Flow(((s.output("first") == "foo", a), (s.output("first") == "bar", b)), rest), ("first",)), "last": Task(lambda s: s.output("c"), ("c",))}, "last")
    assert outputs(choose(up, bad).run(inputs)) == [("SUCCEEDED", "FOO!", None), ("FAILED", None, "told so")]
    assert outputs(choose(deep, up).run(inputs)) == [("SUCCEEDED", "FOO!", None), ("SUCCEEDED", "BAR!", None)]
    one = Workflow({"c": Task(lambda s: Flow(((s.param() == "foo", up),), F.lit("else")))}, "c")
    assert [o for _, o, _ in outputs(one.run(inputs))] == ["FOO!", "else"]


def test_scope_functions_and_headers(inputs):
    w = Workflow(
        {
            "a": Task(lambda s: F.upper(s.input()), inputs={"default": lambda s: s.param(), "n": lambda s: s.param("n") + 1}, headers=lambda s: F.create_map(F.lit("Kind"), F.lower(s.output()))),
            "b": Task(lambda s: F.concat_ws("|", s.input("a", "n"), s.input("a", "gone"), s.headers("a", "Kind"), s.task("a")["status"], F.size(s.headers("a")).cast("string")), ("a",)),
        },
        "b",
    )
    assert [o for _, o, _ in outputs(w.run(inputs))] == ["6|foo|SUCCEEDED|1", "51|bar|SUCCEEDED|1"]


def test_nested_specs_and_parsers(spark, tmp_path):
    (tmp_path / "n.yaml").write_text("output: i\ntasks:\n  i:\n    run: if\n    inputs:\n      then: {run: noop, inputs: hi}\n      else: {output: z, tasks: {z: {run: fail}, y: }}\n      plain: {a: 1}\n      broken: {tasks: 3}\n")
    r = specs.tasks(spark, str(tmp_path)).first()
    import json

    assert json.loads(r.inputs) == {"then": {"kind": "task", "spec": {"run": "noop", "inputs": {"default": "hi"}, "requires": []}}, "else": {"kind": "workflow", "spec": {"output": "z", "tasks": {"z": {"run": "fail", "inputs": {}, "requires": []}}}}, "plain": {"a": 1}, "broken": {"tasks": 3}}
    assert specs.parsed("a: 1") == {"a": 1} and specs.parsed('{"a": 1}', "json") == {"a": 1}
    with pytest.raises(ValueError, match="no parser toml; json"):
        specs.parsed("a: 1", "toml", "json")


def test_workflows_and_dynamic_tasks_api(spark, tmp_path):
    flows = Workflows()
    tasks = {"a": Task(lambda s: s.param())}
    assert Workflows.validate(tasks, "b", "v9") == ["unknown apiVersion v9", "unknown output task 'b'"] and Workflows.validate(tasks, "a") == []
    assert flows.create("w", tasks, "a") is flows.get("w") and flows.list() == ["w"]
    flows.delete("w")
    with pytest.raises(KeyError):
        flows.get("w")
    api = Invocations(spark, str(tmp_path / "events"))
    api.add_task(spark.createDataFrame([("1", "t", "{}"), ("1", "u", "{}"), ("2", "t", "{}")], "invocation_id string, task_id string, spec string"))
    assert sorted(r.task_id for r in api.tasks("1").collect()) == ["t", "u"]
    got = api.validate(spark.createDataFrame([("1", "w"), ("", "w"), ("2", None)], "invocation_id string, workflow_id string"))
    assert [r.error for r in got.collect()] == [None, "no invocation id", "no workflow id"]


@pytest.mark.parametrize(
    ("x", "text"),
    [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-2.5, "-2.5"), (12345678.9, "12345678.9"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (-1.5e22, "-1.5e+22"), (0.0001, "0.0001"), (0.000001, "0.000001"), (1e-7, "1e-7"), (float("nan"), "NaN"), (float("inf"), "Infinity")],
)
def test_numbers_as_scripts_write_them(spark, x, text):
    assert spark.range(1).select(control.script_number(F.lit(x))).first()[0] == text


#: References and their parts.
@pytest.mark.parametrize(("ref", "parts"), [("noRuntime", ("", "", "noRuntime")), ("a://b", ("a", "", "b")), ("flow://some-space/foobar", ("flow", "some-space", "foobar")), ("", None), ("://", None), ("://runtimeId", None), ("runtime://", None)])
def test_references(spark, ref, parts):
    got = spark.range(1).select(web.fnref(F.lit(ref))).first()[0]
    assert (got and tuple(got)) == parts


def test_unknown_workflow_event_fails(spark):
    ev = spark.createDataFrame([("w", "Odd", 1, 1, None)], "workflow_id string, event_type string, event_id long, ts long, value double")
    with pytest.raises(Exception, match="unsupported event: Odd"):
        folds.workflow_state(ev).collect()


def test_stream_resumes_and_replaces_states(spark, tmp_path):
    schema = "event_id long, ts long, user_id long, event_type string, value double"
    batches = [[(1, 1, 1, "signup", 0.0), (2, 2, 2, "signup", 0.0)], [(3, 3, 1, "purchase", 5.0)], [(4, 4, 2, "view", 1.0), (5, 5, 1, "signup", 0.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        fold.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    got = sorted(map(tuple, fold.latest(spark, str(tmp_path / "out/state")).collect()))
    assert got == [(1, "IN_PROGRESS", None), (2, "IN_PROGRESS", None)]
