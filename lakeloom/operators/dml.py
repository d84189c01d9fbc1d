"""Statements that change a table, as DataFrames from the old rows to the new."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended; columns are matched by name, missing ones null."""
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def check_keys(target: DataFrame, key: list[str]) -> None:
    """Raise if a key is null or occurs twice (an aggregate per key; one row reaches the driver)."""
    null_key = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    if not target.where(null_key).isEmpty():
        raise ValueError("null in a primary key")
    if not target.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("a primary key occurs twice")


def one_per_key(rows: DataFrame, key: list[str], last: Column | None = None) -> DataFrame:
    """Of rows with one key the greatest by last, or the first in column order; combined before they are shuffled."""
    whole = F.struct(*rows.columns)
    best = F.min(whole) if last is None else F.max_by(whole, last)
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(best.alias("__row")).select("__row.*")


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new; of several with one key the first in column order."""
    return insert(target, one_per_key(rows, key).join(target.select(*key), key, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], last: Column | None = None) -> DataFrame:
    """Whole rows replaced or added; last orders several incoming rows of one key, the greatest stays."""
    new = one_per_key(rows, key, last)
    return target.join(new.select(*key), key, "left_anti").select(*target.columns).unionByName(new, allowMissingColumns=True).select(*target.columns)


def update(target: DataFrame, changes: dict[str, Column], where: Column, key: list[str] = ()) -> DataFrame:
    """Columns set in the rows where the condition is true; a key column can't be set."""
    low = {k.lower() for k in key}
    if bad := [c for c in changes if c.lower() in low]:
        raise ValueError(f"partition key columns can't be set: {', '.join(bad)}")
    real = {c.lower(): c for c in target.columns}
    if unknown := [c for c in changes if c.lower() not in real]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return target.withColumns({real[c.lower()]: F.when(where, v).otherwise(F.col(real[c.lower()])) for c, v in changes.items()}).select(*target.columns)


def delete(target: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition isn't true."""
    return target.where(~F.coalesce(where, F.lit(False)))


def returning(affected: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the affected rows, or all for *; expressions are left out."""
    return affected if columns in ((), ("*",)) else affected.select(*(c for c in columns if c in affected.columns))


def affected_count(rows: DataFrame, where: Column) -> int:
    return rows.where(where).count()


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.lit(default).cast(kind))


def drop_column(df: DataFrame, name: str, key: list[str] = ()) -> DataFrame:
    if name in key or name not in df.columns:
        raise ValueError(f"column {name} can't be dropped")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f"column {old} can't be renamed {new}")
    return df.withColumnRenamed(old, new)


def alter_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A column's values as another type; null where a value can't be read."""
    return df.withColumn(name, F.col(name).try_cast(kind))


class Snapshots:
    """Atomic table versions: each write is a folder of its own name, which one new pointer file publishes.

    Readers see the version of the greatest pointer that names a folder. Of
    two writers that race for a version the second fails, as Hadoop creates a
    pointer once only, and what it wrote is deleted; the published rows stay.
    """

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The published versions."""
        return sorted(v for v, size in self._pointers().items() if size)

    def _pointers(self) -> dict[int, int]:
        """Version → size of its pointer, 0 while it is being written."""
        at, fs = self._fs(f"{self.root}/_pointers")
        return {int(s.getPath().getName()): s.getLen() for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _folder(self, version: int) -> str:
        at, fs = self._fs(f"{self.root}/_pointers/{version}")
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the newest by default."""
        known = self.versions()
        if version is None and not known or version is not None and version not in known:
            raise ValueError("no such version")
        return self.spark.read.parquet(f"{self.root}/{self._folder(known[-1] if version is None else version)}")

    def commit(self, df: DataFrame) -> int:
        """Publish df as the next version."""
        version = max(self._pointers(), default=0) + 1
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        at, fs = self._fs(f"{self.root}/_pointers/{version}")
        try:
            stream = fs.create(at, False)
        except Exception:
            fs.delete(self._fs(f"{self.root}/{folder}")[0], True)
            raise
        stream.write(bytearray(folder.encode()))
        stream.close()
        return version
