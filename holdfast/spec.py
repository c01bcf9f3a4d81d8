"""Declarations that drive a run: sources, relationships, projects.

Everything here is metadata held by the driver. No Spark object is created, so a
declaration can be validated before a cluster is involved.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from types import MappingProxyType

from pyspark.sql import types as T

# The closed vocabularies a declaration may use.
LOAD_MODES = ("append", "upsert", "snapshot", "replace_period")
DELETION_RULES = ("ignore", "mark_inactive", "soft_delete", "close_version", "physical")
DECLARABLE_DELETION_RULES = ("ignore", "mark_inactive", "soft_delete")
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
JOIN_TYPES = ("inner", "left", "full")
SPARK_TYPES: Mapping[str, T.DataType] = MappingProxyType({
    "VARCHAR": T.StringType(),
    "DATE": T.DateType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "DECIMAL(18,4)": T.DecimalType(18, 4),
    "DECIMAL(18,2)": T.DecimalType(18, 2),
})
IDENTIFIER = re.compile(r"^[a-z][a-z0-9_]*$")

# Columns stamped on every staged row, and the ones history adds. Fixed names.
LINEAGE_COLUMNS = (
    "_run_id", "_report_id", "_source_id", "_source_file", "_source_file_hash",
    "_source_sheet", "_source_row_number", "_extracted_at", "_schema_version",
)
# Position of a row within the whole extract; orders rows across several files.
ROW_ORDER = "_row_order"
# Line of a staged CSV row with more cells than its header.
EXTRA_CELLS = "_extra_cells"
KEY_HASH = "business_key_hash"
CONTENT_HASH = "row_content_hash"


class SpecError(ValueError):
    """A declaration is incomplete or contradicts itself."""


def _identifier(value: str, what: str) -> str:
    if not IDENTIFIER.fullmatch(value):
        raise SpecError(f"{what} {value!r} is not a lower_snake_case name")
    return value


def is_numeric(kind: str) -> bool:
    return kind.startswith(("DECIMAL", "INTEGER", "BIGINT"))


@dataclass(frozen=True)
class Source:
    """One logical table of a project: its columns, key, checks and load mode."""

    source_id: str
    columns: Mapping[str, str]
    key: tuple[str, ...]
    load_mode: str
    event_date: str | None = None
    lookback_days: int = 0
    # Share of a stored month's rows that a batch replacing it must bring; 0 replaces whatever comes.
    least_period_share: float = 0.0
    deletion_rule: str = "ignore"
    required: bool = True
    required_columns: tuple[str, ...] = ()
    control_totals: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()
    categories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    file_patterns: tuple[str, ...] = ("*",)
    sheet: str = ""
    role: str = "other"
    grain: str = ""

    def __post_init__(self) -> None:
        sid = _identifier(self.source_id, "source_id")
        if not self.columns:
            raise SpecError(f"{sid}: declare every column with its type")
        for name, kind in self.columns.items():
            _identifier(name, f"{sid}: column")
            if kind not in SPARK_TYPES:
                raise SpecError(f"{sid}.{name}: type {kind!r} is not one of {sorted(SPARK_TYPES)}")
        if not self.key:
            raise SpecError(f"{sid}: a business key is needed")
        if self.load_mode not in LOAD_MODES:
            raise SpecError(f"{sid}: load mode {self.load_mode!r} is not one of {LOAD_MODES}")
        if self.deletion_rule not in DELETION_RULES:
            raise SpecError(f"{sid}: deletion rule {self.deletion_rule!r} is not one of {DELETION_RULES}")
        used = {*self.key, *self.required_columns, *self.control_totals, *self.non_negative, *self.categories}
        if self.event_date:
            used.add(self.event_date)
        if undeclared := sorted(used - set(self.columns)):
            raise SpecError(f"{sid}: no type is declared for {undeclared}")
        for name in self.control_totals:
            if not is_numeric(self.columns[name]):
                raise SpecError(f"{sid}: control total {name!r} needs a numeric type")
        if not self.file_patterns:
            raise SpecError(f"{sid}: at least one file pattern is needed")

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.columns)

    @property
    def period_column(self) -> str:
        """Column that places a row in time: the event date, else the first key."""
        return self.event_date or self.key[0]

    def typed_schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[k]) for n, k in self.columns.items()])

    def history_schema(self) -> T.StructType:
        return T.StructType([
            *self.typed_schema().fields,
            T.StructField(KEY_HASH, T.StringType()),
            T.StructField(CONTENT_HASH, T.StringType()),
            T.StructField("is_active", T.BooleanType()),
            T.StructField("first_seen_run_id", T.StringType()),
            T.StructField("last_seen_run_id", T.StringType()),
            T.StructField("_source_file", T.StringType()),
            T.StructField("_source_row_number", T.LongType()),
        ])


@dataclass(frozen=True)
class Relationship:
    """A declared link between two sources, checked on every run."""

    relationship_id: str
    left: str
    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    cardinality: str = "many_to_one"
    join_type: str = "left"
    confirmed: bool = True
    require_match: bool = False

    def __post_init__(self) -> None:
        rid = _identifier(self.relationship_id, "relationship_id")
        if not self.left_keys or len(self.left_keys) != len(self.right_keys):
            raise SpecError(f"{rid}: both sides need the same, non-empty number of keys")
        if self.cardinality not in CARDINALITIES:
            raise SpecError(f"{rid}: cardinality {self.cardinality!r} is not one of {CARDINALITIES}")
        if self.join_type not in JOIN_TYPES:
            raise SpecError(f"{rid}: join type {self.join_type!r} is not one of {JOIN_TYPES}")


@dataclass(frozen=True)
class Project:
    """Sources and relationships that are loaded and published together."""

    project_id: str
    sources: tuple[Source, ...]
    relationships: tuple[Relationship, ...] = ()
    version: int = 1
    template_version: str = ""

    def __post_init__(self) -> None:
        pid = _identifier(self.project_id, "project_id")
        if not self.sources:
            raise SpecError(f"{pid}: at least one source is needed")
        _unique([s.source_id for s in self.sources], f"{pid}: source_id")
        _unique([r.relationship_id for r in self.relationships], f"{pid}: relationship_id")
        known = {s.source_id: s for s in self.sources}
        for rel in self.relationships:
            for sid, keys in ((rel.left, rel.left_keys), (rel.right, rel.right_keys)):
                if sid not in known:
                    raise SpecError(f"{rel.relationship_id}: source {sid!r} does not exist")
                if unknown := sorted(set(keys) - set(known[sid].columns)):
                    raise SpecError(f"{rel.relationship_id}: {sid} has no column {unknown}")

    def source(self, source_id: str) -> Source:
        return next(s for s in self.sources if s.source_id == source_id)

    def view_name(self, source_id: str) -> str:
        return f"history_{self.project_id}_{source_id}"


def _unique(values: list[str], what: str) -> None:
    if doubled := sorted({v for v in values if values.count(v) > 1}):
        raise SpecError(f"{what} is used twice: {doubled}")


def load_project(directory: str | Path) -> Project:
    """Build a :class:`Project` from ``project.toml``, ``sources.toml``, ``relationships.toml``."""
    root = Path(directory)

    def read(name: str) -> dict:
        path = root / name
        if not path.is_file():
            raise SpecError(f"project file {name} is missing")
        return tomllib.loads(path.read_text("utf-8"))

    head, declared, links = read("project.toml"), read("sources.toml"), read("relationships.toml")
    template = head.get("template", {})
    if not (template.get("template_id") and template.get("template_version")):
        raise SpecError("project.toml must name its template and template version")
    return Project(
        project_id=str(head.get("project_id", "")).strip(),
        version=int(head.get("project_version", 1)),
        template_version=str(template["template_version"]),
        sources=tuple(_source_from(entry) for entry in declared.get("sources", [])),
        relationships=tuple(_relationship_from(entry) for entry in links.get("relationships", [])),
    )


def _source_from(entry: Mapping) -> Source:
    sid = str(entry.get("source_id", "")).strip()
    history, quality = entry.get("history", {}), entry.get("quality", {})
    rule = str(history.get("deletion_rule", ""))
    if rule not in DECLARABLE_DELETION_RULES:
        raise SpecError(f"{sid}: deletion rule {rule!r} is not one of {DECLARABLE_DELETION_RULES}")
    sheet = str(entry.get("discovery", {}).get("sheet", "")).strip()
    if not sheet:
        raise SpecError(f"{sid}: name the sheet to read")

    def texts(block: Mapping, name: str) -> tuple[str, ...]:
        return tuple(str(v) for v in block.get(name, ()))

    return Source(
        source_id=sid,
        columns={str(n): str(k).upper() for n, k in entry.get("column_types", {}).items()},
        key=texts(entry, "business_key"),
        load_mode=str(history.get("mode", "")),
        event_date=str(entry["event_date"]) if entry.get("event_date") else None,
        lookback_days=int(history.get("lookback_days", 0)),
        least_period_share=float(history.get("least_period_share", 0)),
        deletion_rule=rule,
        required=bool(entry.get("required", True)),
        required_columns=texts(quality, "required_columns"),
        control_totals=texts(quality, "control_totals"),
        non_negative=texts(quality, "non_negative_columns"),
        categories={str(c): tuple(str(v) for v in allowed)
                    for c, allowed in quality.get("approved_categories", {}).items()},
        file_patterns=texts(entry.get("match", {}), "file_patterns"),
        sheet=sheet,
        role=str(entry.get("role", "other")),
        grain=str(entry.get("grain", "")),
    )


def _relationship_from(entry: Mapping) -> Relationship:
    return Relationship(
        relationship_id=str(entry.get("relationship_id", "")).strip(),
        left=str(entry.get("left_source", "")),
        right=str(entry.get("right_source", "")),
        left_keys=tuple(str(k) for k in entry.get("left_keys", ())),
        right_keys=tuple(str(k) for k in entry.get("right_keys", ())),
        cardinality=str(entry.get("cardinality", "")),
        join_type=str(entry.get("join_type", "")),
        confirmed=str(entry.get("approval_state", "UNKNOWN")) == "CONFIRMED",
        require_match=bool(entry.get("require_match", False)),
    )
