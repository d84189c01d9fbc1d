import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import compat
from lakeloom.operators import aggregates, dml, movement
from lakeloom.streaming import cdc


def table_of(spark, rows, ddl="id long, a string, b long"):
    return spark.createDataFrame(rows, ddl)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_statements(spark):
    t = table_of(spark, [(1, "x", 1), (2, "y", None)])
    new = table_of(spark, [(2, "z", 5), (3, "w", 6), (3, "v", 7)])
    assert rows_of(dml.insert_ignore(t, new, ["id"])) == [(1, "x", 1), (2, "y", None), (3, "v", 7)]
    assert rows_of(dml.upsert(t, new, ["id"], F.col("b"))) == [(1, "x", 1), (2, "z", 5), (3, "v", 7)]
    assert rows_of(dml.update(t, {"A": F.lit("q")}, F.col("b") == 1)) == [(1, "q", 1), (2, "y", None)]
    assert rows_of(dml.delete(t, F.col("b") == 1)) == [(2, "y", None)]
    with pytest.raises(ValueError):
        dml.update(t, {"ID": F.lit(1)}, F.lit(True), ["id"])
    with pytest.raises(ValueError):
        dml.check_keys(dml.insert(t, new), ["id"])
    with pytest.raises(ValueError):
        dml.drop_column(t, "id", ["id"])
    assert rows_of(dml.alter_type(table_of(spark, [(1, "12", 0), (2, "1x", 0)]), "a", "int").select("a")) == [(12,), (None,)]


def test_snapshots_are_atomic_versions(spark, tmp_path):
    shots = dml.Snapshots(spark, str(tmp_path))
    t = table_of(spark, [(1, "x", 1)])
    assert shots.commit(t) == 1 and shots.commit(dml.insert(shots.read(), table_of(spark, [(2, "y", 2)]))) == 2
    assert shots.read().count() == 2 and shots.read(1).count() == 1
    with pytest.raises(ValueError):
        shots.read(9)


def test_of_two_racing_writers_one_fails_and_harms_nothing(spark, tmp_path):
    first, second = dml.Snapshots(spark, str(tmp_path)), dml.Snapshots(spark, str(tmp_path))
    first.commit(spark.range(3).toDF("id"))
    stale = second._pointers()
    second._pointers = lambda: stale
    first.commit(spark.range(10).toDF("id"))
    with pytest.raises(Exception, match="exist"):
        second.commit(spark.range(5).toDF("id"))
    assert first.versions() == [1, 2] and first.read().count() == 10 and first.read(1).count() == 3


def test_late_changes_do_not_bring_deleted_rows_back(spark):
    ddl = "id long, a string, at long"
    table = table_of(spark, [(1, "x", 1), (2, "y", 1)], ddl)
    step = lambda t, *changes: cdc.merge_into(t, table_of(spark, changes, ddl + ", operation string"), ["id"], "at")
    table = step(table, (1, None, 5, "DELETE"))
    assert rows_of(cdc.current(table)) == [(2, "y", 1)]
    table = step(table, (1, "late", 3, "UPDATE"), (3, "z", 2, "INSERT"))
    assert rows_of(cdc.current(table)) == [(2, "y", 1), (3, "z", 2)]
    assert rows_of(cdc.current(step(table, (1, "new", 6, "INSERT")))) == [(1, "new", 6), (2, "y", 1), (3, "z", 2)]


def test_buckets_are_those_of_utf16_units(spark):
    def bucket(key):
        h = 2166136261
        units = key.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[k : k + 2])) * 16777619) % 2**32
        return h % 16

    keys = ["", "a", "é", "日本", "😀x", "\U0010ffff"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", movement.bucket_of(F.col("k")).alias("b")).collect()
    assert {r.k: r.b for r in got} == {k: bucket(k) for k in keys}


def test_stream_merges_into_snapshots(spark, tmp_path):
    ddl = "id long, a string, hlc struct<physical: bigint, logical: int, node: string>, operation string"
    changes = [(1, "new", (5, 0, "n"), "UPDATE"), (2, None, (9, 0, "n"), "DELETE"), (3, "c", (1, 0, "n"), "INSERT"), (1, "stale", (2, 0, "n"), "UPDATE")]
    spark.createDataFrame(changes, ddl).write.parquet(str(tmp_path / "in"))
    shots = dml.Snapshots(spark, str(tmp_path / "t"))
    shots.commit(spark.createDataFrame([(1, "old", (3, 0, "n")), (2, "b", (3, 0, "n"))], ddl.rsplit(",", 1)[0]))
    q = cdc.start_merge(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), shots, ["id"], "hlc", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted((r.id, r.a) for r in cdc.current(shots.read()).collect()) == [(1, "new"), (3, "c")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.sampled_from("ab")), st.integers(0, 9), st.sampled_from(["INSERT", "UPDATE", "DELETE"])), min_size=1, max_size=14, unique_by=lambda c: (c[0], c[2])), st.sampled_from([1, 3, 16]))
def test_last_writer_wins_whatever_the_partitions(spark, changes, parts):
    df = spark.createDataFrame(changes, "id long, a string, at int, operation string").repartition(parts)
    newest = {}
    for c in changes:
        if c[0] not in newest or c[2] > newest[c[0]][2]:
            newest[c[0]] = c
    assert rows_of(cdc.apply_changes(df, ["id"], "at").select("id", "a", "at")) == sorted(((c[0], c[1], c[2]) for c in newest.values() if c[3] != "DELETE"), key=repr)
    filled = {}
    for c in sorted(changes, key=lambda c: c[2]):
        filled[c[0]] = c[1] if c[1] is not None else filled.get(c[0])
    assert dict(rows_of(cdc.backfill(df, ["id"], "at", ["a"]))) == filled


def test_aggregates(spark):
    t = table_of(spark, [(3, "x", 2), (1, "x", 5), (2, "y", 2), (4, "y", None)])
    assert rows_of(aggregates.select_star_with(t, ["a"], ["id"], F.count("*").alias("n"))) == [("x", 1, 5, 2), ("y", 2, 2, 2)]
    assert rows_of(aggregates.mode(t, "b")) == [(2, 2)]
    assert [t.where(w).agg(aggregates.sum_or_null("b").alias("s")).first().s for w in ("id < 0", "id = 4", "true")] == [0, None, 9]
    one = table_of(spark, [(7, "x", -7)])
    assert tuple(one.select(compat.int_div(F.col("b"), F.lit(2)), compat.int_mod(F.col("b"), F.lit(0)), compat.lenient_cast(F.col("a"), "int")).first()) == (-3, None, None)


def test_movement(spark):
    assert movement.decide(10).strategy == "broadcast" and movement.decide(1 << 30, "pk").strategy == "lookup" and movement.decide(1 << 30).strategy == "emit_shuffle"
    for hint, size, path in (("broadcast", 1 << 30, None), ("lookup", 1, "scan"), ("guess", 1, None)):
        with pytest.raises(ValueError):
            movement.decide(size, path, hint)
    t = table_of(spark, [(i, str(i % 3), i) for i in range(30)])
    assert {r.id for r in movement.lookup(t, [("id", 1), ("id", 1), ("id", 5)], ["id"])} == {1, 5}
    for keys, allowed in (([("b", 1)], ["id"]), ([], ["id"]), ([("id", i) for i in range(1001)], ["id"])):
        with pytest.raises(ValueError):
            movement.lookup(t, keys, allowed)
    chunks = movement.with_continuation(t, "a", ["id"], 4).groupBy("a", "chunk", "token").count().collect()
    assert len(chunks) == 9 and sorted(r["count"] for r in chunks if r.token is None) == [2, 2, 2]
    with pytest.raises(ValueError):
        movement.emitted_within(t.select(F.col("a").alias("k"), F.lit("x" * 100).alias("v")), "k", "v", 50)
    store = movement.Broadcasts(spark, 100)
    assert store.publish("x", [1]) == 1 and store.publish("x", [2]) == 2 and store.use("x").value == [2] and store.delete("x") and "x" not in store
    with pytest.raises(ValueError):
        store.publish("y", "z" * 200)


def test_numeric_aware_sort_and_chunk_statistics(spark):
    df = spark.createDataFrame([(v,) for v in ("10", "9", "b", None, "-1.5", "a", "9")], "v string")
    order = [r.v for r in df.orderBy(*aggregates.numeric_aware("v")).collect()]
    assert order == ["-1.5", "9", "9", "10", "a", "b", None]
    assert [r.v for r in df.orderBy(*aggregates.numeric_aware("v", True)).collect()] == [*reversed(order[:-1]), None]
    stats = aggregates.ChunkStats(3)
    for rows, chunks in ((df, 3), (df.limit(0), 0)):
        assert stats.watch(rows).groupBy().count().first()[0] == rows.count()
        got = stats.get()
        assert got["total_rows"] == rows.count() and got["chunk_count"] == chunks and (got["estimated_bytes"] > 0) == (chunks > 0)
        stats.reset()
