from __future__ import annotations

import os
import time

import pytest

from holdfast.plans.packs import MAINTENANCE_DOWNTIME
from holdfast.sources.store import Store
from holdfast.streaming.incremental import load_arrivals

HEADER = "event_date,line,event_id,machine,reason,downtime_minutes,planned_flag\n"


def deliver(folder, name: str, rows: str, age: int) -> None:
    path = folder / name
    path.write_text(HEADER + rows, encoding="utf-8")
    stamp = time.time() - age
    os.utime(path, (stamp, stamp))


def test_arrivals_load_once_in_order_and_a_bad_one_stops_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "store"), MAINTENANCE_DOWNTIME, buckets=2)
    runs = []

    def load():
        query = load_arrivals(spark, MAINTENANCE_DOWNTIME, "downtime", str(folder), store,
                              str(tmp_path / "checkpoint"), on_run=runs.append)
        query.awaitTermination()

    deliver(folder, "downtime_1.csv", "2026-08-01,L1,E1,M1,Breakdown,60,false\n", 300)
    deliver(folder, "downtime_2.csv", "2026-08-01,L1,E1,M1,Breakdown,65,false\n2026-08-02,L1,E2,M1,Other,5,true\n", 200)
    load()
    assert [(r.sources["downtime"].inserted, r.sources["downtime"].updated) for r in runs] == [(1, 0), (1, 1)]
    load()
    assert len(runs) == 2  # nothing new, nothing repeated

    deliver(folder, "downtime_3.csv", "2026-08-03,L1,,M1,Other,5,true\n", 100)
    with pytest.raises(Exception, match="BlockedBatch|blocked"):
        load()
    history = {r.event_id: float(r.downtime_minutes) for r in store.history(MAINTENANCE_DOWNTIME.sources[0]).collect()}
    assert history == {"E1": 65.0, "E2": 5.0}
