"""SparkSession factory with the settings every module of the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Data-movement threshold: sides up to this many bytes may be broadcast.
BROADCAST_LIMIT_BYTES = 256 * 1024


def build_session(app: str = "lakeloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session on so many cores for tests and benches; without a number spark-submit decides where and how wide."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
