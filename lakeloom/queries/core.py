"""The flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query

#: Weight of the prior mean in the shrunk score, and the penalty on few rows.
PRIOR_ROWS = 20
PENALTY = 0.5


@query(
    f"""
    WITH g AS (SELECT l_partkey, CAST(count(l_quantity) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total
               FROM lineitem GROUP BY l_partkey),
         p AS (SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS mean FROM lineitem)
    SELECT l_partkey, n, round((total + {PRIOR_ROWS} * mean) / (n + {PRIOR_ROWS}) - {PENALTY} / sqrt(n), 6) AS score
    FROM g CROSS JOIN p WHERE n > 0 ORDER BY score DESC, l_partkey LIMIT 10
    """
)
def quality_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of each part, shrunk to the overall mean, less a penalty for few rows; the ten best.

    One scan feeds the partial aggregate; the overall mean is the aggregate of
    the per-part sums, a single row.
    """
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    parts = rows.groupBy("l_partkey").agg(F.count("q").alias("n"), F.sum("q").alias("sum_q"))
    overall = parts.agg((F.sum("sum_q").cast("double") / F.sum("n")).alias("mean"))
    score = (F.col("sum_q").cast("double") + PRIOR_ROWS * F.col("mean")) / (F.col("n") + PRIOR_ROWS) - PENALTY / F.sqrt("n")
    return (
        parts.where("n > 0").crossJoin(F.broadcast(overall))
        .select("l_partkey", "n", F.round(score, 6).alias("score"))
        .orderBy(F.desc("score"), "l_partkey").limit(10)
    )
