"""Analyses: functions of rows over declared paths, with typed parameters given as JSON."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from typing import Any, get_type_hints

from pyspark.sql import DataFrame

from tidemark.functions.paths import PARTS, enabled_paths

#: JSON's names of the types that parameters may have.
JSON_TYPES = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array"}


@dataclasses.dataclass(frozen=True)
class Analysis:
    """``run(rows, parameters)`` over the rows whose paths match ``paths`` (``source/topic/datatype``, ``*`` for any)."""

    paths: tuple[str, ...]
    run: Callable[[DataFrame, Any], DataFrame]
    parameters: type


def described(kind: type) -> dict[str, dict]:
    """Type of each parameter of a dataclass, and its default or that it is required."""
    hints = get_type_hints(kind)
    out = {}
    for f in dataclasses.fields(kind):
        needed = f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
        out[f.name] = {"type": JSON_TYPES[hints[f.name]]} | ({"required": True} if needed else {"default": f.default if f.default is not dataclasses.MISSING else f.default_factory()})
    return out


def parameters(kind: type, text: str) -> Any:
    """A dataclass of parameters from JSON; ValueError for unknown, missing or wrongly typed ones."""
    given, hints = json.loads(text), get_type_hints(kind)
    if not isinstance(given, dict):
        raise ValueError("parameters are an object")
    wanted = described(kind)
    if unknown := given.keys() - wanted.keys():
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    if missing := {k for k, v in wanted.items() if "required" in v} - given.keys():
        raise ValueError(f"missing parameters: {', '.join(sorted(missing))}")
    for name, value in given.items():
        fits = (int, float) if hints[name] is float else hints[name]
        if not isinstance(value, fits) or (isinstance(value, bool) and hints[name] is not bool):
            raise ValueError(f"{name} is no {wanted[name]['type']}: {value!r}")
    return kind(**given)


def analysed(analysis: Analysis, rows: DataFrame, text: str = "{}") -> DataFrame:
    """The analysis of ``rows``, any table or stream of series: a store, a replay, or rows made for it."""
    names = [tuple(p.split("/")) for p in analysis.paths]
    rules = rows.sparkSession.createDataFrame(names, ", ".join(f"{p} string" for p in PARTS))
    return analysis.run(enabled_paths(rows, rules), parameters(analysis.parameters, text))
