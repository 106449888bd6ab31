"""Versioned tables (S12, U05, U06): a small table that is replaced as a whole, with a pointer to its current version.

A version is written aside and counts from the moment its number is in the pointer, which is appended last: a job that
fails before that leaves the current version as it was, and a repeated task writes the same files. A run is known by an
id; a run whose id is in the pointer was done before and changes nothing, so jobs can be repeated. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version long, run string"


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, run) of every version."""
    try:
        return spark.read.schema(POINTER).json(f"{path}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the current version, 0 if there is none."""
    return history(spark, path).agg(F.max("version").alias("v")).first()["v"] or 0


def read_current(spark: SparkSession, path: str, first: DataFrame) -> DataFrame:
    """The current version, or ``first`` where the table has none yet."""
    v = current_version(spark, path)
    return spark.read.schema(first.schema).parquet(f"{path}/versions/{v}") if v else first


def run_id(*tables: DataFrame) -> str:
    """Id of what a run is given: the same rows in any order give the same id."""
    parts = []
    for t in tables:
        r = t.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in t.columns])).alias("x"),
                  F.sum(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in t.columns], F.lit(1)), F.lit(1 << 30))).alias("s")).first()
        parts.append(f"{r['n']}-{r['x'] or 0}-{r['s'] or 0}")
    return "/".join(parts)


def commit(df: DataFrame, path: str, run: str) -> int:
    """Write ``df`` as the next version; the number of the version that the run made, now or before."""
    spark = df.sparkSession
    done = history(spark, path).where(F.col("run") == run).agg(F.max("version").alias("v")).first()["v"]
    if done:
        return done
    v = current_version(spark, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/versions/{v}")
    spark.createDataFrame([(v, run)], POINTER).coalesce(1).write.mode("append").json(f"{path}/pointer")
    return v
