"""Header names: normalising them and finding approved columns by name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MissingColumns(ValueError):
    """Approved columns are absent from the header."""


def tidy_name(name: str, position: int) -> str:
    """Lower snake case; a blank name takes its position, a leading digit a ``c_``."""
    tidy = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
    if not tidy:
        return f"col_{position}"
    return f"c_{tidy}" if tidy[0].isdigit() else tidy


def tidy_header(names: Sequence[str]) -> list[str]:
    """Normalise a whole header; repeats get ``_2``, ``_3`` in order of appearance."""
    tidied = [tidy_name(str(name), position) for position, name in enumerate(names)]
    repeats = [tidied[: i + 1].count(name) for i, name in enumerate(tidied)]
    return [name if n == 1 else f"{name}_{n}" for name, n in zip(tidied, repeats)]


def with_tidy_header(frame: DataFrame) -> DataFrame:
    return frame.toDF(*tidy_header(frame.columns))


def project_by_name(frame: DataFrame, approved: Sequence[str]) -> DataFrame:
    """Select approved columns whatever their position, case or padding.

    The first of two equal headers wins. Only the chosen columns reach the scan.
    """
    def folded(name: str) -> str:
        return name.strip().casefold()

    positions: dict[str, int] = {}
    for position, name in enumerate(frame.columns):
        positions.setdefault(folded(name), position)
    if missing := sorted(name for name in approved if folded(name) not in positions):
        raise MissingColumns(f"approved columns {missing} are not in the header {frame.columns}")
    # Unique stand-in names let a header with repeated names be addressed by position.
    numbered = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    return numbered.select(*[F.col(f"c{positions[folded(name)]}").alias(name) for name in approved])
