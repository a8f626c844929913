"""Plans from configuration: YAML that names a source, steps and a sink, resolved against lists of what is allowed.

    source: {name: points}
    steps:
      - {name: finite, args: {features: hd}}
      - {name: knn, args: {k: 12, column: hd}}
    sink: {name: parquet, args: {path: /data/neighbours}}

Names and arguments are checked before any row is read: an unknown name or argument, a missing one and a wrong type are errors
that say where. Nothing but the listed functions can be called.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import NamedTuple, get_type_hints

from pyspark.sql import DataFrame, SparkSession

from ..operators import metric_cells, prep, treeforces
from ..operators import neighbours as nb
from ..operators import points as tables
from . import lines

#: Sources by name: functions of the session, the folder of the tables, and arguments.
SOURCES: dict[str, Callable[..., DataFrame]] = {
    "points": lambda spark, folder: tables.points(spark, folder),
    "cells": lambda spark, folder: tables.lineage_cells(spark, folder),
}
#: Steps by name: functions of a table and arguments.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "finite": prep.require_finite,
    "sanitise": prep.sanitise,
    "z_score": prep.z_score,
    "min_max": prep.min_max,
    "log_counts": prep.log_counts,
    "top_variance": prep.top_variance,
    "drop_rare": prep.drop_rare,
    "label_codes": prep.label_codes,
    "pad_even": prep.pad_even,
    "keep_first": prep.keep_first,
    "knn": nb.knn,
    "knn_cells": metric_cells.knn,
    "tree_forces": treeforces.tree_forces,
}
SINKS: dict[str, Callable[..., None]] = {}


def source(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Adds a source under the name of its function."""
    SOURCES[f.__name__] = f
    return f


def sink(f: Callable[..., None]) -> Callable[..., None]:
    """Adds a sink under the name of its function."""
    SINKS[f.__name__] = f
    return f


@source
def table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """Some columns of a table of the folder."""
    return tables.read(spark, folder, name).select(*[f"`{c}`" for c in columns])


@source
def text(spark: SparkSession, folder: str, matrix: str, label: str) -> DataFrame:
    """A text matrix and a file of labels, matched by place; both lie in the folder."""
    return lines.matched_by_place(spark, f"{folder}/{matrix}", {"label": f"{folder}/{label}"}).withColumnRenamed("line", "id")


@sink
def parquet(df: DataFrame, path: str) -> None:
    """A new Parquet table."""
    df.write.parquet(path)


class Call(NamedTuple):
    """A listed function and its arguments."""

    function: Callable
    args: dict


class Recipe(NamedTuple):
    """A checked plan."""

    source: Call
    steps: list[Call]
    sink: Call | None


def _fits(value, kind) -> bool:
    """Whether a YAML value is of a parameter's type; whole numbers pass for numbers, truth values never do."""
    text = str(kind)
    if "None" in text and value is None:
        return True
    if text.startswith("list[str]"):
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    for name, types in (("str", str), ("bool", bool), ("int", int), ("float", (int, float))):
        if (kind is {"str": str, "bool": bool, "int": int, "float": float}[name]) or text.startswith(f"{name} |"):
            return isinstance(value, types) and (name == "bool" or not isinstance(value, bool))
    return False


def _call(node, listed: dict[str, Callable], given: int, at: str) -> Call:
    if not isinstance(node, dict) or not set(node) <= {"name", "args"} or not isinstance(node.get("name"), str):
        raise ValueError(f"{at}: give a name, and args if there are any")
    if node["name"] not in listed:
        raise ValueError(f"{at}: {node['name']} is not one of {sorted(listed)}")
    function, args = listed[node["name"]], node.get("args") or {}
    if not isinstance(args, dict):
        raise ValueError(f"{at}: args are names and values")
    hints = get_type_hints(function)
    free = [p for p in list(inspect.signature(function).parameters.values())[given:] if p.kind is not inspect.Parameter.VAR_KEYWORD]
    if unknown := set(args) - {p.name for p in free}:
        raise ValueError(f"{at}: {node['name']} has no argument {sorted(unknown)}")
    if missing := [p.name for p in free if p.default is inspect.Parameter.empty and p.name not in args]:
        raise ValueError(f"{at}: {node['name']} needs {missing}")
    for name, value in args.items():
        if not _fits(value, hints.get(name)):
            raise ValueError(f"{at}: {name} is {value!r}, no {hints.get(name)}")
    return Call(function, args)


def parsed(recipe: str) -> Recipe:
    """The plan of a YAML text, checked."""
    import yaml

    node = yaml.safe_load(recipe)
    if not isinstance(node, dict) or not set(node) <= {"source", "steps", "sink"} or "source" not in node:
        raise ValueError("a recipe has a source, and may have steps and a sink")
    steps = node.get("steps") or []
    if not isinstance(steps, list):
        raise ValueError("steps are a list")
    made = [_call(s, STEPS, 1, f"step {k}") for k, s in enumerate(steps)]
    return Recipe(_call(node["source"], SOURCES, 2, "source"), made, _call(node["sink"], SINKS, 1, "sink") if node.get("sink") else None)


def run(spark: SparkSession, folder: str, recipe: str) -> DataFrame:
    """The table that a YAML text describes, written to its sink if it has one."""
    plan = parsed(recipe)
    df = plan.source.function(spark, folder, **plan.source.args)
    for step in plan.steps:
        df = step.function(df, **step.args)
    if plan.sink:
        plan.sink.function(df, **plan.sink.args)
    return df
