"""Queries over events on fixtures that the test tables don't hold."""

from datetime import datetime, timedelta

from lakeloom.queries import QUERIES

_DDL = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_events_over_the_emit_budget_are_grouped(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), 1, "view", 1.0, "x" * (1 << 20)) for i in range(17)]
    spark.createDataFrame(rows, _DDL).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["emit_group"](spark, str(tmp_path)).collect()] == [("view", 17, 17 << 20)]


def test_every_event_has_its_place(spark, tmp_path):
    start = datetime(2024, 1, 1, 0, 59)
    # Out of order, several in an hour, two at one time, and one type throughout.
    at = [start + timedelta(minutes=m) for m in (300, 0, 2, 1, 1, 90, 30)]
    spark.createDataFrame([(i, t, 1, "view", 1.0, "{}") for i, t in enumerate(at)], _DDL).write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(range(len(at)), key=lambda i: (at[i], i))
    got = QUERIES["hlc_places"](spark, str(tmp_path)).collect()
    assert [(r.event_id, r.place) for r in got] == [(i, k + 1) for k, i in enumerate(want)]
