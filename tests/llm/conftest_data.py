"""Rows of a result as plain, sorted tuples."""

from __future__ import annotations


def frame_rows(frame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
