from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.plans import diagnostics, dialect, logs, pruning, statements
from lakeloom.plans.classifier import classify
from lakeloom.plans.params import bind
from lakeloom.sources.tables import table

DATA = "/root/testdata/sf0.001"


def test_parameters():
    assert bind("a = ? AND b = '?'", [1]) == ("a = ? AND b = '?'", [1])
    assert bind("a = $2 AND b = $1 OR c = $2 -- $9", [1, 2]) == ("a = ? AND b = ? OR c = ? -- $9", [2, 1, 2])
    assert bind("a = ?2 AND b = ?1", ["x", "y"]) == ("a = ? AND b = ?", ["y", "x"])
    for sql, values in (("a = $1 AND b = $3", [1, 2, 3]), ("a = $2", [1]), ("a = ?", []), ("a = ? AND b = $1", [1]), ("a", [1])):
        with pytest.raises(ValueError):
            bind(sql, values)


def test_dialect(spark):
    row = dialect.query(spark, "SELECT EXTRACT(dow FROM TIMESTAMP '2024-01-07 10:11:12') AS dow, DATE_TRUNC('day', TIMESTAMP '2024-01-07 10:11:12') AS d, 'now()' AS t, substr('hello', 0, 2) AS s, \"x\" FROM (SELECT 1 AS x)").first()
    assert tuple(row) == (0, "2024-01-07 00:00:00", "now()", "h", 1)
    for bad in ("SELECT EXTRACT(week FROM ts)", "SELECT DATE_TRUNC('week', ts)"):
        with pytest.raises(ValueError):
            dialect.translate(bad)
    got = dialect.query(spark, "SELECT 'say \"hi\" it''s \\\\ a/b' AS t, 55/10 AS q, -55/10 AS m, 7/0 AS z, 5.5/2 AS d, 100/7/2 AS c, (1+8)/2 AS e, ?/2 AS p -- x/y", [9]).first()
    assert got.t == 'say "hi" it\'s \\\\ a/b' and (got.q, got.m, got.z, float(got.d), got.c, got.e, got.p) == (5, -5, None, 2.75, 7, 4, 4)
    got = dialect.query(spark, "SELECT COUNT(*), sum( x ) , SUM(x)/COUNT(*) AS mean, max(x) AS top FROM (SELECT explode(array(1, 2, 4)) AS x)")
    assert got.columns == ["COUNT(*)", "SUM(x)", "mean", "top"] and tuple(got.first()) == (3, 7, 2, 4)
    day, now, at = dialect.query(spark, "SELECT CURRENT_DATE, CURRENT_TIMESTAMP, CURRENT_TIME").first()
    assert (len(day), len(now), len(at)) == (10, 19, 8) and now.startswith(day)
    assert dialect.parse_live(" live  select * from t ") == "select * from t"
    with pytest.raises(ValueError):
        dialect.parse_live("SELECT * FROM t")
    assert dialect.call_binding("CALL BINDING $1", ['{"name": "x"}']) == {"name": "x"}
    assert dialect.command_tag("insert into t", 3) == "INSERT 0 3" and dialect.command_tag("CREATE TABLE", 0) == "OK"
    assert dialect.plan_id("SELECT  a", [1]) == dialect.plan_id("select a ", [1]) != dialect.plan_id("select a", [2])
    with pytest.raises(ValueError):
        dialect.literal_statement("SELECT * FROM a JOIN b")


@pytest.mark.parametrize(
    ("sql", "bounded"),
    [
        ("SELECT due FROM loans WHERE copy = ? AND reader = ?", True), (f"SELECT due FROM loans WHERE copy IN ({'?, ' * 99}?)", True), (f"SELECT due FROM loans WHERE copy IN ({'?, ' * 100}?)", False),
        ("SELECT copy FROM loans WHERE due < ?", False), ("SELECT copy FROM loans WHERE due < ? LIMIT 3", True), ("SELECT copy FROM loans WHERE reader IN (SELECT reader FROM fines)", False),
    ],
)
def test_nested_calls(sql, bounded):
    assert (classify(sql).classification == "BOUNDED") is bounded


def test_reach():
    assert pruning.classify_predicate("id = 5 AND x > 1", "id") == pruning.Reach("eq", (5,))
    assert pruning.classify_predicate("? = id", "id", [7]).values == (7,)
    assert pruning.classify_predicate("id IN ('a', 'b')", "id").values == ("a", "b")
    assert pruning.classify_predicate("id BETWEEN 1 AND 9 AND y = 2", "id")[2:] == (1, 9)
    assert pruning.classify_predicate("id = ?", "id").shape == "scatter" == pruning.classify_predicate("id IN (1, ?)", "id").shape
    assert pruning.partitions_reached(pruning.classify_predicate("id = ?", "id"), [("a", None, 5), ("b", 5, None)]) == ["a", "b"]
    assert pruning.classify_predicate("id = 1 OR x = 2", "id").shape == "scatter" == pruning.classify_predicate("x = 2", "id").shape


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=5, unique=True), st.integers(-60, 60), st.integers(-60, 60))
def test_ranges_hold_each_key_once(cuts, low, high):
    cuts.sort()
    ends = [None, *cuts, None]
    ranges = [(f"p{i}", a, b) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    pruning.validate_ranges(ranges)
    assert len(pruning.partitions_reached(pruning.Reach("eq", (low,)), ranges)) == 1
    reached = set(pruning.partitions_reached(pruning.Reach("between", (), low, high), ranges))
    assert {pruning.partitions_reached(pruning.Reach("eq", (k,)), ranges)[0] for k in range(low, high + 1)} <= reached


def test_range_changes():
    parts = pruning.split_range(("p", None, 9), 4, "a", "b")
    assert parts == [("a", None, 4), ("b", 4, 9)] and pruning.merge_ranges(*parts, "p") == ("p", None, 9)
    for bad in (lambda: pruning.split_range(("p", 1, 9), 9, "a", "b"), lambda: pruning.merge_ranges(("a", 1, 2), ("b", 3, 4), "c"), lambda: pruning.validate_ranges([("a", None, 3), ("b", 4, None)])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        pruning.split_range(("p", "a", None), 4, "a", "b")


def test_plans_push_down_and_prune(spark):
    found = diagnostics.summary(table(spark, DATA, "orders").where("o_orderkey = 5").select("o_custkey"))
    assert "EqualTo(o_orderkey,5)" in found["pushed"][0] and found["read"][0].count(":") == 2 and not found["python"]
    advice = diagnostics.advise("SELECT * FROM users u JOIN orders o ON u.id = o.customer_id WHERE u.email = ? ORDER BY o.order_date", {"users": [["email"], ["id"]]})
    assert advice["access"] == "index_scan" and {"table": "orders", "columns": ["customer_id"], "use": "join"} in advice["suggestions"]
    assert diagnostics.advise("SELECT * FROM users WHERE status = 1")["access"] == "full_scan"


def test_statements_that_change_a_table(spark):
    t = spark.createDataFrame([(1, "x", 10), (2, "y", None)], "id long, a string, b long")
    do = lambda sql, *params: statements.change(spark, sql, list(params), {"t": ["id"]}, t=t)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = do("INSERT INTO t (id, a) VALUES (3, 'it''s RETURNING'), (?, ?) RETURNING id, a", 4, "q?")
    assert rows(got.rows) == [(1, "x", 10), (2, "y", None), (3, "it's RETURNING", None), (4, "q?", None)] and rows(got.touched) == [(3, "it's RETURNING"), (4, "q?")]
    got = do("INSERT OR IGNORE INTO t VALUES (1, 'z', 0), (5, 'w', 1) RETURNING *")
    assert rows(got.rows) == [(1, "x", 10), (2, "y", None), (5, "w", 1)] and rows(got.touched) == [(5, "w", 1)]
    got = do("INSERT INTO t VALUES (1, 'z', 0) ON CONFLICT (id) DO UPDATE SET a = excluded.a")
    assert rows(got.rows) == [(1, "z", 0), (2, "y", None)]
    got = do("UPDATE t SET b = b / 3, a = 'a, b = 1 WHERE' WHERE id = 1 RETURNING b")
    assert rows(got.rows) == [(1, "a, b = 1 WHERE", 3.0), (2, "y", None)] and rows(got.touched) == [(3.0,)]
    assert rows(do("DELETE FROM t WHERE b > 5").rows) == [(2, "y", None)] and rows(do("DELETE FROM t").rows) == []
    assert do("ALTER TABLE t ADD COLUMN c INTEGER DEFAULT 7").rows.where("c = 7").count() == 2
    assert do("ALTER TABLE t DROP COLUMN b").rows.columns == ["id", "a"] and do("CREATE INDEX i ON t (a)").rows.count() == 2
    for bad in ("UPDATE t SET id = 1", "ALTER TABLE t DROP COLUMN id", "SELECT 1", "INSERT INTO t (z) VALUES (1)", "CREATE INDEX i ON t (z)", "INSERT INTO t (id) VALUES (1, 2)"):
        with pytest.raises(ValueError):
            do(bad)


def test_log_search():
    now = datetime(2024, 3, 1, 12)
    assert logs.since("-15m", now) == datetime(2024, 3, 1, 11, 45) and logs.since("-2D", now).day == 28 and logs.since("2024-01-01", now).year == 2024
    with pytest.raises(ValueError):
        logs.since("-15w", now)
    assert logs.LogSearch().statement() == ("SELECT * FROM logs ORDER BY timestamp DESC, created_at DESC, log_id DESC LIMIT 200", [])
    search = logs.LogSearch(equal=(("level", "ERROR"), ("node_id", None)), start=now, contains="it's")
    sql, values = search.statement()
    assert " WHERE level = ?1 AND timestamp >= ?2 AND message LIKE ?3 ORDER" in sql and values == ["ERROR", "2024-03-01 12:00:00", "%it's%"]
    assert search.live().startswith("LIVE SELECT") and "message LIKE '%it''s%' ORDER" in search.live() and "?" not in search.live()
    assert diagnostics.call_report(["SELECT a FROM t WHERE k = ?", "SELECT a FROM t"]) == {"bounded": 1, "rejected": 1, "statements": ["SELECT a FROM t"]}
