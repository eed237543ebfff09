"""Workflow specifications in YAML or JSON files, as a table of tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, task_id string, function_ref string, inputs string, requires array<string>, is_output boolean, error string"
#: What a task without a function does.
DEFAULT_FUNCTION = "noop"


#: Parsers by name, in the order in which they are tried; each gives what the text says or a ValueError.
PARSERS: dict[str, Callable[[str], object]] = {"json": json.loads, "yaml": yaml.safe_load}


def parsed(text: str, *names: str) -> object:
    """What the first parser makes of the text that can read it; of some parsers if any are named."""
    errors = []
    for n in names or PARSERS:
        if n not in PARSERS:
            errors.append(f"no parser {n}")
            continue
        try:
            return PARSERS[n](text)
        except (ValueError, yaml.YAMLError) as e:
            errors.append(f"{n}: {str(e).splitlines()[0]}")
    raise ValueError("; ".join(errors))


def task_of(body: dict) -> dict:
    """A task's function, inputs and dependencies; what isn't there takes its default."""
    inputs = {} if body.get("inputs") is None else body["inputs"]
    inputs = inputs if isinstance(inputs, dict) else {"default": inputs}
    requires = body.get("requires") or []
    return {"run": body.get("run") or DEFAULT_FUNCTION, "inputs": {str(k): value_of(v) for k, v in inputs.items()}, "requires": [str(r) for r in requires]}


def workflow_of(spec: object) -> dict:
    if not isinstance(spec, dict) or not isinstance(spec.get("tasks"), dict):
        raise ValueError("no tasks")
    return {"output": str(spec.get("output")), "tasks": {str(t): task_of(b) for t, b in spec["tasks"].items() if b is not None}}


def value_of(v: object) -> object:
    """An input: a map that runs something is a task, one with tasks a workflow (if they can be read), others stay."""
    if not isinstance(v, dict):
        return v
    for key, kind, read in (("run", "task", task_of), ("tasks", "workflow", workflow_of)):
        if key in v:
            try:
                return {"kind": kind, "spec": read(v)}
            except (ValueError, AttributeError, TypeError):
                break
    return {str(k): x for k, x in v.items()}


def task_rows(path: str, text: str) -> list[tuple]:
    """The tasks of one specification; what can't be read gives a row with an error."""
    try:
        spec = workflow_of(parsed(text))
        return [(path, t, b["run"], json.dumps(b["inputs"], sort_keys=True, default=str), b["requires"], t == spec["output"], None) for t, b in spec["tasks"].items()]
    except (ValueError, AttributeError, TypeError) as e:
        return [(path, None, None, None, None, None, str(e).splitlines()[0])]


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The tasks of every file of a folder, a file at a time on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["value"]) for r in task_rows(p, t)], columns=names)

    files = spark.read.text(folder, wholetext=True).selectExpr("_metadata.file_path AS path", "value")
    return files.mapInPandas(read, SCHEMA)
