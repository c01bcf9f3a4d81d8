"""Declared rules: a function from named inputs to a table of a declared shape.

A rule receives DataFrames and returns a DataFrame, so its work is Spark's. Its output
is checked against the declaration and never coerced silently.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdfast.spec import IDENTIFIER, SPARK_TYPES


class RuleError(RuntimeError):
    """A rule is declared badly, failed, or returned something undeclared."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: str
    inputs: tuple[str, ...]
    output_table: str
    output_columns: Mapping[str, str]
    evaluate: Callable[[Mapping[str, DataFrame]], DataFrame]

    def __post_init__(self) -> None:
        for value, what in ((self.rule_id, "rule_id"), (self.output_table, "output table"),
                            *((c, "output column") for c in self.output_columns)):
            if not IDENTIFIER.fullmatch(value):
                raise RuleError(f"{what} {value!r} is not a lower_snake_case name")
        if not self.version:
            raise RuleError(f"{self.rule_id}: a version is needed")
        if not self.inputs:
            raise RuleError(f"{self.rule_id}: name the queries it reads")
        if not self.output_columns:
            raise RuleError(f"{self.rule_id}: declare its output columns")
        if unknown := sorted(set(self.output_columns.values()) - set(SPARK_TYPES)):
            raise RuleError(f"{self.rule_id}: output types {unknown} are not supported")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[k]) for n, k in self.output_columns.items()])


def run_rule(rule: Rule, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Evaluate one rule over its named inputs and check the shape of what it returns."""
    try:
        produced = rule.evaluate({name: inputs[name] for name in rule.inputs})
    except Exception as problem:
        raise RuleError(f"{rule.rule_id} failed: {type(problem).__name__}: {problem}") from problem
    return checked_output(rule, produced)


def checked_output(rule: Rule, produced: object) -> DataFrame:
    if not isinstance(produced, DataFrame):
        raise RuleError(f"{rule.rule_id} returned {type(produced).__name__}, not a DataFrame")
    got = [(f.name, f.dataType) for f in produced.schema.fields]
    want = [(f.name, f.dataType) for f in rule.schema.fields]
    if [n for n, _ in got] != [n for n, _ in want]:
        raise RuleError(f"{rule.rule_id} returned columns {[n for n, _ in got]}, declared {[n for n, _ in want]}")
    if wrong := [f"{n}: {g.simpleString()}, declared {w.simpleString()}"
                 for (n, g), (_, w) in zip(got, want) if g != w]:
        raise RuleError(f"{rule.rule_id} returned other types: {'; '.join(wrong)}")
    return produced


def unique_outputs(rules: Sequence[Rule]) -> None:
    for what, values in (("rule_id", [r.rule_id for r in rules]), ("output table", [r.output_table for r in rules])):
        if len(set(values)) != len(values):
            raise RuleError(f"{what} is used twice")
