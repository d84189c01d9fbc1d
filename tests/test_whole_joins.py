"""Joins over whole tables, on a fixture with unmatched rows on both sides."""

import pytest

from lakeloom.queries import QUERIES

# A hot customer with an odd key, one whose key is divisible by 3, one without orders, orders of nobody.
CUSTOMERS = [(3, "c3"), (7, "c7"), (8, "c8"), (9, "c9")]
ORDERS = [*[(k, 7) for k in range(1, 51)], (60, 3), (61, 8), (62, 5), (63, 4), (64, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("joins"))
    spark.createDataFrame([(*c, 1, 0.0, "BUILDING") for c in CUSTOMERS], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(*o, 10.0) for o in ORDERS], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full"])
def test_whole_join(spark, tables, kind):
    got = [(r.c_custkey, r.o_orderkey) for r in QUERIES[f"join_{kind}"](spark, tables).collect()]
    want = [(c, o) for c, _ in CUSTOMERS for o, k in ORDERS if k == c]
    want += [(9, None)] * (kind in ("left", "full"))
    want += [(None, o) for o in (62, 63, 64)] * (kind in ("right", "full"))
    assert sorted(got, key=repr) == sorted(want, key=repr)
