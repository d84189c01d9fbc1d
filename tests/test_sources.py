import pytest
from pyspark.sql import functions as F

from lakeloom.sources.catalog import Catalog, KeyedReads, default_literal, parse_create_table, storage_class
from lakeloom.sources.tables import PRIMARY_KEYS, read_tsv, register, table

DATA = "/root/testdata/sf0.001"


def test_create_table(spark):
    catalog = Catalog(spark)
    t = catalog.create("CREATE TABLE ratings (user_id INT, movie_id INT, rating DECIMAL(3, 1) NOT NULL, note VARCHAR(20) DEFAULT 'it''s', ok BOOLEAN DEFAULT TRUE, PRIMARY KEY (user_id, movie_id)) WITH (split_storage_threshold = 10)")
    assert t.key == ["user_id", "movie_id"] and t.options == {"split_storage_threshold": "10"}
    assert [f.dataType.simpleString() for f in t.schema] == ["bigint", "bigint", "double", "string", "bigint"] and not t.schema["rating"].nullable
    row = catalog.with_defaults("ratings", spark.sql("SELECT 1 AS user_id, 2 AS movie_id, 4.5 AS rating")).first()
    assert tuple(row) == (1, 2, 4.5, "it's", 1)
    assert catalog.system_tables()["columns"].where("in_key").count() == 2 and spark.table("ratings").count() == 0
    assert catalog.create("CREATE TABLE IF NOT EXISTS ratings (a INT PRIMARY KEY)") is t
    with pytest.raises(ValueError):
        catalog.create("CREATE TABLE ratings (a INT PRIMARY KEY)")
    with pytest.raises(ValueError):
        parse_create_table("CREATE TABLE t (a INT)")
    catalog.drop("ratings")
    assert not catalog.tables
    assert storage_class("varchar(9)") == "TEXT" and storage_class("jsonb") == "JSONB" and [default_literal(x) for x in (True, 2, "a'b")] == ["1", "2", "'a''b'"]


def test_keyed_reads(spark):
    reads = KeyedReads(table(spark, DATA, "nation").cache(), "n_nationkey")
    assert reads.get(3).n_nationkey == 3 and reads.get(99) is None and reads.has(0) and reads.count() == 25
    assert reads.find(F.col("n_regionkey") == 1).n_regionkey == 1 and reads.filter(lambda df: df.n_regionkey == 1).count() == 5 and reads.get_all().count() == 25


def test_tables_and_tsv(spark, tmp_path):
    register(spark, DATA)
    for name, key in PRIMARY_KEYS.items():
        df = spark.table(name)
        if name == "lineitem":  # the generated lines repeat keys
            continue
        assert df.count() == df.select(*key).distinct().count()
    (tmp_path / "r.tsv").write_text("1\t2\t3.5\t9\n4\t5\t1.0\t9\n")
    assert read_tsv(spark, str(tmp_path / "r.tsv"), "user_id long, movie_id long, rating double, at long").agg(F.sum("rating")).first()[0] == 4.5
    (tmp_path / "bad.tsv").write_text("x\t2\t3.5\t9\n")
    with pytest.raises(Exception, match="[Mm]alformed"):
        read_tsv(spark, str(tmp_path / "bad.tsv"), "user_id long, movie_id long, rating double, at long").collect()
