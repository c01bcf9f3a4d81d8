from __future__ import annotations

import numpy as np
import pytest

from conftest_data import frame_rows
from holdfast.llm import rotation_codes

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]
SCHEMA = "vec_id long, embedding array<float>, label int, key long, unit string, n int, bucket long"


def plain(rows) -> list[tuple]:
    """All pairs by their cosine, in double precision."""
    units = []
    for _, v in rows:
        x = np.array([np.nan if c is None else np.float32(c) for c in v], dtype=np.float64) if v else np.zeros(1)
        units.append(x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95:
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[root(i)] = root(j)
    least = {}
    for i, (vec, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), vec) if x is not None), default=None)
    return sorted(((v, links[i], least[root(i)], v == least[root(i)]) for i, (v, _) in enumerate(rows)), key=repr)


def as_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], SCHEMA).repartition(4)


def around(dice, centre, cosine, n):
    """Vectors at a cosine of a centre."""
    w = dice.normal(size=(n, len(centre)))
    w -= (w @ centre)[:, None] * centre
    w /= np.linalg.norm(w, axis=1)[:, None]
    return cosine * centre + np.sqrt(1 - cosine ** 2) * w


@pytest.fixture(scope="module")
def rows():
    dice, rows = np.random.default_rng(4), []
    centres = dice.normal(size=(60, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    for c in centres[:40]:
        rows += [c, *around(dice, c, 0.951, 3), *around(dice, c, 0.97, 3), *around(dice, c, 0.949, 2)]
    rows += [*around(dice, centres[50], 0.995, 200)]  # a ball: all linked
    rows += [*around(dice, centres[51], 0.975, 200)]  # a crowd without a ball: linked or not, pair by pair
    rows += [centres[52]] * 40 + [3 * centres[52], 1e30 * centres[52], -centres[52]]  # copies, other lengths, the opposite
    listed = [x.astype(np.float32).tolist() for x in rows]
    listed += [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31]
    listed += [[1.0, 2.0], [1.0, 2.1], [2.0, 1.0], [1.0], [3.0], [-1.0]]
    return [*((7 * i % 5000 - 100, v) for i, v in enumerate(listed)), (None, listed[0]), (None, [5.0, -5.0]), (9999, listed[1]), (9999, listed[1])]


def test_links_equal_all_pairs(spark, rows):
    assert frame_rows(rotation_codes.linked_vectors(as_frame(spark, rows)), COLUMNS) == plain(rows)


def test_parts_of_crowds_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(rotation_codes, "CROWD", 4)
    monkeypatch.setattr(rotation_codes, "BLOCK", 16)
    assert frame_rows(rotation_codes.linked_vectors(as_frame(spark, rows)), COLUMNS) == plain(rows)


def test_a_ball_forms_no_pairs(spark, rows):
    dice = np.random.default_rng(9)
    centre = np.eye(32)[0]
    crowd = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([centre, *around(dice, centre, 0.996, 400)])]
    units = rotation_codes.unit_vectors(as_frame(spark, crowd)).withColumnRenamed("row", "key")
    codes = rotation_codes.coded(units, 401, 0.95)
    members = rotation_codes.balls(codes, units, 0.95)
    assert rotation_codes.candidates(codes, members, 0.95).count() < 401 * 20 < 401 * 400 // 2


def test_estimates_are_unbiased_and_bounded():
    dice = np.random.default_rng(1)
    u = dice.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = np.concatenate([around(dice, c, 0.951, 1) for c in u])
    import pandas as pd

    code, factor, planes, least, step = rotation_codes.Rotations(64, 800, 0.95).codes(np.concatenate([u, v]))
    frame = pd.DataFrame({"code": [p.tobytes() for p in np.concatenate([code, planes], axis=1)], "factor": factor, "least": least, "step": step})
    codes = rotation_codes.Codes(frame, 64)
    i = np.arange(400)
    assert codes.may_link(i, i + 400, 0.95).all()
    assert not codes.may_link(i[:-1], i[1:], 0.95).any()
    assert codes.may_link(i[:, None], i[None, :] + 400, 0.95).sum() < 500


def test_no_vectors(spark):
    assert rotation_codes.linked_vectors(as_frame(spark, []).limit(0)).count() == 0
    assert frame_rows(rotation_codes.linked_vectors(as_frame(spark, [(3, None), (4, [0.0])])), COLUMNS) == [(3, 0, 3, True), (4, 0, 4, True)]
