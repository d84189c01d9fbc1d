import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.operators.movement import place_in_order
from lakeloom.runtime import budgets as b
from lakeloom.runtime.operation import Operation, Registry, distributed, reduced, run, staged
from lakeloom.streaming import cdc, hlc, live


def _count(rows, args, emit):
    emit("n", len(rows))
    emit("sum", sum(r["v"] for r in rows))


def test_partials_reduce_the_same_for_any_shards(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS v")
    for shards in (1, 3, 16):
        assert distributed(df, ["id"], _count, lambda p, _: (p["n"], p["sum"]), shards=shards) == (5000, sum(i % 7 for i in range(5000)))
    df.createOrReplaceTempView("numbers")
    assert Operation("SELECT id, v FROM numbers WHERE id < 10", _count, lambda p, _: p["n"]).call(spark, ["id"]) == 10


def test_whole_partials_keep_their_digits(spark):
    def big(rows, args, emit):
        emit("n", sum(2**53 + 1 for _ in rows))
        emit("half", 0.5)

    got = distributed(spark.range(5).toDF("id"), ["id"], big, lambda p, _: p, shards=2)
    assert got["n"] == 5 * (2**53 + 1) and got["half"] >= 0.5


def test_gates(spark):
    df = spark.range(100).selectExpr("id", "id AS v")

    def many(rows, args, emit):
        for i in range(200):
            emit(str(i), 1)

    def bad(rows, args, emit):
        emit("x", float("nan"))

    for function in (many, bad):
        with pytest.raises(Exception, match="emits|finite"):
            distributed(df, ["id"], function, lambda p, _: p)
    with pytest.raises(ValueError, match="share"):
        distributed(df, ["id"], _count, lambda p, _: p, disjoint=True)


def test_run_context(spark):
    t = spark.range(2500).selectExpr("id", "id % 5 AS k")

    def work(ctx):
        sizes = ctx.call("SELECT * FROM t", handler=lambda rows, c: (len(rows), c.out([rows[0].id])["accepted"]))
        assert next(ctx.call("SELECT id FROM t WHERE id = ?", [7])).id == 7
        assert [r.id for r in ctx.lookup("t", [("id", 3)], ["id"])] == [3]
        assert ctx.once("s", lambda: 1) == ctx.once("s", lambda: 2) == 1
        return [n for n, _ in sizes]

    got = run(spark, work, t=t)
    assert got["result"] == [1000, 1000, 500] and len(got["output"]) == 3
    with pytest.raises(b.BudgetExceeded, match="bounded"):
        run(spark, lambda ctx: ctx.call("SELECT * FROM t", handler=lambda rows, c: c.call("SELECT * FROM t")), t=t)
    with pytest.raises(b.BudgetExceeded):
        run(spark, lambda ctx: ctx.frame("SELECT count(*) FROM t a, t b, t c").collect(), b.Budgets(wall_s=1), t=t)


def test_budgets(spark):
    assert len(b.bounded_rows(spark.range(10), b.Budgets(rows=10))) == 10
    with pytest.raises(b.BudgetExceeded):
        b.bounded_rows(spark.range(11), b.Budgets(rows=10))
    stream = b.ResultStream(3, 1000)
    assert stream.push([1, 2])["accepted"] == 2 and stream.push([3, 4]) == {"accepted": 1, "total_rows": 3, "total_bytes": 3, "exceeded": True}
    token = b.Token()
    child = token.child()
    token.cancel("stop")
    with pytest.raises(b.Cancelled):
        child.check()
    assert b.stragglers({"a": 1, "b": 1, "c": 9, "d": 5}) == [("c", 3.0)] and b.stragglers({"a": 5}) == []
    registry = Registry()
    registry.register("len", lambda ctx, rows: len(rows))
    assert registry.query_with_callback(spark.range(250), "len") == [100, 100, 50] and registry.query_then_invoke(spark.range(7), "len") == 7
    with pytest.raises(ValueError):
        registry.register("x", len, "wasm")


def test_clock():
    now = [100]
    clock = hlc.Clock("n", lambda: now[0], 50)
    stamps = [clock.now(), clock.now()]
    now[0] = 90
    stamps += [clock.now(), clock.update(hlc.Stamp(300, 4, "m")), clock.now()]
    assert stamps == sorted(stamps) and len(set(stamps)) == 5 and clock.warnings == 1


def test_live_queries(spark, tmp_path):
    q = live.LiveQuery("LIVE SELECT * FROM orders WHERE status = 'open' AND amount > 5")
    assert q.signature == live.LiveQuery("LIVE SELECT id FROM orders WHERE amount > 5 AND status = 'open'").signature
    assert live.LiveQuery("LIVE SELECT * FROM t WHERE id IN (1, 2)").reach("id").values == (1, 2)
    assert spark.createDataFrame([("LIKE new",), ("like NEW",)], "name string").where(live.LiveQuery("LIVE SELECT * FROM t WHERE name = 'LIKE new'").predicate).count() == 1
    now = [0.0]
    subs = live.Subscriptions(30, 2, lambda: now[0])
    a, _ = subs.subscribe("c", "LIVE SELECT * FROM t"), subs.subscribe("c", "LIVE SELECT id FROM t")
    assert len(subs.groups()) == 1
    with pytest.raises(ValueError):
        subs.subscribe("c", "LIVE SELECT * FROM t")
    now[0] = 20.0
    assert subs.renew(a, 5, 3) == "resumed" and subs.renew(a, 1, 3) == "resync"
    now[0] = 45.0
    assert len(subs.expire()) == 1 and a in subs.held


def test_stream_gives_the_batch_twins_events(spark, tmp_path):
    changes = [(1, 1, "INSERT", 9), (1, 2, "UPDATE", 2), (1, 3, "UPDATE", 8), (2, 4, "INSERT", 1), (2, 5, "UPDATE", 7), (2, 6, "UPDATE", 9), (2, 7, "DELETE", 9), (3, 8, "DELETE", 9)]
    df = spark.createDataFrame(changes, "id long, at long, operation string, v long")
    df.where("at <= 5").write.parquet(str(tmp_path / "in"))
    hit = F.col("v") > 5
    want = {(r.at, r.event) for r in live.transitions(df, "id", ["at"], hit).collect()}
    assert want == {(1, "insert"), (2, "delete"), (3, "insert"), (5, "insert"), (6, "update"), (7, "delete")}
    events = live.stream_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "at", hit)
    q = events.writeStream.format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        df.where("at > 5").write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        assert {(r.at, r.event) for r in spark.table("live_out").collect()} == want
    finally:
        q.stop()


def test_stages_and_reductions_run_beside_the_data(spark):
    keys = [None, -5, -5, *range(0, 30000, 7), 9 * 10**12]
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, batch string").repartition(5)
    placed = {r["__place"]: r.k for r in place_in_order(df, "k", 64).collect()}
    assert [placed[i] for i in range(len(keys))] == keys

    def handler(batch, rows):
        return pd.DataFrame({"batch": [batch], "n": [len(rows)], "low": [rows["k"].min()]})

    got = sorted(tuple(r) for r in staged(df, "k", handler, "batch long, n long, low double", 500).collect())
    assert [r[:2] for r in got] == [(i, min(500, len(keys) - 500 * i)) for i in range(-(-len(keys) // 500))] and got[1][2] == keys[500]
    assert staged(df.limit(0), "k", handler, "batch long, n long, low double").count() == 0

    def reduce(key, records, chunk, token):
        return pd.DataFrame({"key": [key], "chunk": [chunk], "n": [len(records)], "token": [token]})

    rows = spark.createDataFrame([("a", i) for i in range(25)] + [(None, 1)], "key string, i long")
    found = reduced(rows, "key", ["i"], reduce, "key string, chunk long, n long, token string", 10).collect()
    assert {tuple(r) for r in found} == {("a", 0, 10, "a-chunk-0"), ("a", 1, 10, "a-chunk-1"), ("a", 2, 5, None), (None, 0, 1, None)}


def test_access_counts_and_telemetry(spark):
    counts = b.AccessCounts()
    for service, parts, kind in (("s", ["p", "q"], "read"), ("s", ["p"], "write"), ("", ["p"], "read"), ("s", ["p", ""], "look")):
        counts.record(service, parts, kind)
    held = counts.snapshot()
    assert not counts.counts and sum(held.values()) == 3
    counts.record("s", ["p"], "read")
    counts.merge(held)
    counts.merge(None)
    assert [tuple(r) for r in counts.frame(spark).collect()] == [("s", "p", 2, 1), ("s", "q", 1, 0)]
    seen = b.Telemetry()
    assert seen.timed("lookup", lambda: "four", len) == "four" and seen.seen["lookup"][:2] == [1, 4]


def test_event_buffer():
    held = cdc.EventBuffer("id", {"nodes"}, 3)

    def event(table, key, stamp):
        return {"table": table, "operation": "UPDATE", "data": {"id": key}, "timestamp": stamp}

    assert all(held.put(event(*e)) for e in (("nodes", 1, 1), ("t", 1, 2), ("nodes", 1, 3), ("t", 1, 4))) and len(held) == 3
    assert not held.put(event("t", 2, 5)) and held.dropped == 1 and len(held.recent) == 5
    sent = []

    def send(e):
        if e["timestamp"] == 4 and len(sent) == 1:
            sent.append(None)
            raise OSError
        sent.append(e["timestamp"])

    with pytest.raises(OSError):
        held.replay(send)
    assert sent == [3, None] and len(held) == 2
    held.put(event("t", 2, 5))  # again: sent once
    assert held.replay(send) == 2 and sent == [3, None, 4, 5] and len(held) == 0
