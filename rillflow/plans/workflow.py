"""A workflow as a function from invocations to invocations: every task is three columns of the row.

A task is a function of the scope that gives its output column, or (output, error). Tasks run in waves:
one runs if no task of an earlier wave failed, so tasks beside a failed one still run. Catalyst sees one
projection and fuses all tasks of a row."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCEEDED, FAILED, UNKNOWN = "SUCCEEDED", "FAILED", "UNKNOWN"


class Scope:
    """What a task may refer to: the invocation's inputs and other tasks' inputs, outputs, headers and states."""

    def __init__(self, inputs: DataFrame | list[str], prefix: str = "", current: str | None = None) -> None:
        self._inputs = inputs if isinstance(inputs, list) else inputs.columns
        self._prefix, self._current = prefix, current

    def at(self, task: str) -> Scope:
        """The scope as a task sees it: what is asked without a name is its own."""
        return Scope(self._inputs, self._prefix, task)

    def within(self, prefix: str) -> Scope:
        """The scope of tasks whose columns start with a prefix."""
        return Scope(self._inputs, prefix)

    def _column(self, task: str | None, what: str) -> Column:
        return F.col(f"`{self._prefix}{task or self._current}_{what}`")

    def param(self, name: str = "default") -> Column:
        return F.col(f"`{name}`") if name in self._inputs else F.lit(None)

    def input(self, task: str | None = None, key: str = "default") -> Column:
        """A task's input of a name; only of tasks that declare inputs."""
        return F.try_element_at(self._column(task, "inputs"), F.lit(key))

    def output(self, task: str | None = None) -> Column:
        return self._column(task, "output")

    def headers(self, task: str | None = None, key: str | None = None) -> Column:
        """A task's output headers (a map), or one of them; only of tasks that declare headers."""
        return self._column(task, "headers") if key is None else F.try_element_at(self._column(task, "headers"), F.lit(key))

    def status(self, task: str | None = None) -> Column:
        return self._column(task, "status")

    def task(self, task: str | None = None) -> Column:
        """struct<output, error, status> of a task."""
        return F.struct(*[self._column(task, what).alias(what) for what in ("output", "error", "status")])


@dataclass(frozen=True)
class Flow:
    """What a task returns whose output is dataflow: of several workflows a row runs the first whose condition holds.

    Its tasks see the invocation's inputs; their columns are <task>_child<i>.<name>_output and so on. A row for which no
    condition holds has ``otherwise``."""

    branches: tuple[tuple[Column, Workflow], ...]
    otherwise: Column | None = None


Body = Callable[[Scope], "Column | tuple[Column, Column] | Flow"]


@dataclass(frozen=True)
class Task:
    run: Body
    requires: tuple[str, ...] = ()
    #: Replaces a successful task's output; sees the actual one as its own output.
    override: Callable[[Scope], Column] | None = None
    #: A map of the output's headers, which sees the (replaced) output.
    headers: Callable[[Scope], Column] | None = None
    #: Inputs that other tasks may ask for, as text.
    inputs: Mapping[str, Callable[[Scope], Column]] = field(default_factory=dict)


@dataclass(frozen=True)
class Workflow:
    tasks: Mapping[str, Task]
    output: str
    api_version: str = "v1"
    waves: dict[str, int] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        errors, waves = self.check()
        if errors:
            raise ValueError("; ".join(errors))
        object.__setattr__(self, "waves", waves)

    def check(self) -> tuple[list[str], dict[str, int]]:
        """Every rule the workflow breaks, and each task's wave."""
        errors = []
        if self.api_version and self.api_version.lower() != "v1":
            errors.append(f"unknown apiVersion {self.api_version}")
        if not self.tasks:
            errors.append("no tasks")
        if self.output not in self.tasks:
            errors.append(f"unknown output task {self.output!r}")
        for t, task in self.tasks.items():
            errors += [f"task {t} requires undefined {r}" for r in task.requires if r not in self.tasks]
        waves: dict[str, int] = {}
        while ready := [t for t, task in self.tasks.items() if t not in waves and all(r in waves or r not in self.tasks for r in task.requires)]:
            waves |= {t: 1 + max((waves[r] for r in self.tasks[t].requires if r in waves), default=0) for t in ready}
        if len(waves) < len(self.tasks):
            errors.append("cycle")
        if self.tasks and all(task.requires for task in self.tasks.values()):
            errors.append("no start task")
        return errors, waves

    def run(self, invocations: DataFrame) -> DataFrame:
        """The invocations with <task>_output, <task>_error and <task>_status, and status, output, error."""
        scope = Scope(invocations)
        df = self._tasks(invocations, scope, "", F.lit(True))
        ok, output, reason = self._result(scope, "")
        return df.withColumns({"status": F.when(ok, SUCCEEDED).otherwise(FAILED), "output": output, "error": reason})

    def _tasks(self, df: DataFrame, scope: Scope, prefix: str, runs: Column) -> DataFrame:
        """df with the columns of all tasks, wave by wave, for the rows that run."""
        ready = F.coalesce(runs, F.lit(False))
        for wave in range(1, max(self.waves.values()) + 1):
            names = [t for t in self.tasks if self.waves[t] == wave]
            given = {f"{prefix}{t}_inputs": F.create_map(*[x for k, v in self.tasks[t].inputs.items() for x in (F.lit(k), v(scope.at(t)).cast("string"))]) for t in names if self.tasks[t].inputs}
            df = df.withColumns(given) if given else df
            columns = {}
            for t in names:
                made = self.tasks[t].run(scope.at(t))
                if isinstance(made, Flow):
                    df, made = self._flow(df, scope, f"{prefix}{t}_child", ready, made)
                out, error = made if isinstance(made, tuple) else (made, F.lit(None).cast("string"))
                columns[f"{prefix}{t}_output"] = F.when(ready & error.isNull(), out)
                columns[f"{prefix}{t}_error"] = F.when(ready, error)
                columns[f"{prefix}{t}_status"] = F.when(~ready, UNKNOWN).when(error.isNotNull(), FAILED).otherwise(SUCCEEDED)
            df = df.withColumns(columns)
            for what in ("override", "headers"):
                named = "output" if what == "override" else what
                after = {f"{prefix}{t}_{named}": F.when(scope.status(t) == SUCCEEDED, f(scope.at(t))) for t in names if (f := getattr(self.tasks[t], what))}
                df = df.withColumns(after) if after else df
            ready = F.forall(F.array(*[scope.status(t) for t in self.tasks if self.waves[t] <= wave]), lambda s: s == SUCCEEDED)
        return df

    def _result(self, scope: Scope, prefix: str) -> tuple[Column, Column, Column]:
        """Whether all tasks succeeded; the output then, else the reason."""
        ok = F.forall(F.array(*[scope.status(t) for t in self.tasks]), lambda s: s == SUCCEEDED)
        # of several failures the first task's by name is told
        reason = F.coalesce(*[F.col(f"`{prefix}{t}_error`") for t in sorted(self.tasks)])
        return ok, F.when(ok, scope.output(self.output)), F.when(~ok, reason)

    def _flow(self, df: DataFrame, scope: Scope, name: str, ready: Column, flow: Flow) -> tuple[DataFrame, tuple[Column, Column]]:
        """df with the tasks of every branch, and (output, error) of the one that each row takes."""
        df = df.withColumn(f"{name}_taken", F.coalesce(*[F.when(ready & c, F.lit(i)) for i, (c, _) in enumerate(flow.branches)]))
        taken, outputs, errors = F.col(f"`{name}_taken`"), [], []
        for i, (_, branch) in enumerate(flow.branches):
            inner = scope.within(f"{name}{i}.")
            df = branch._tasks(df, inner, f"{name}{i}.", taken == i)
            _, output, reason = branch._result(inner, f"{name}{i}.")
            outputs.append(F.when(taken == i, output))
            errors.append(F.when(taken == i, reason))
        rest = F.lit(None) if flow.otherwise is None else flow.otherwise
        return df, (F.coalesce(*outputs, F.when(taken.isNull(), rest)), F.coalesce(*errors))

    def as_task(self, prefix: str, inputs: Callable[[Scope], Mapping[str, Column]], requires: tuple[str, ...] = ()) -> dict[str, Task]:
        """This workflow's tasks inside another one: the output task is called ``prefix``, others prefix.name."""
        name = {t: prefix if t == self.output else f"{prefix}.{t}" for t in self.tasks}

        class Inner(Scope):
            def __init__(self, outer: Scope) -> None:
                self.outer, self.given = outer, inputs(outer)

            def param(self, key: str = "default") -> Column:
                return self.given.get(key, F.lit(None))

            def _column(self, task: str | None, what: str) -> Column:
                return F.col(f"`{name[task]}_{what}`")

        def body(task: Task) -> Body:
            return lambda outer: task.run(Inner(outer))

        return {name[t]: Task(body(task), tuple(name[r] for r in task.requires) or requires) for t, task in self.tasks.items()}
