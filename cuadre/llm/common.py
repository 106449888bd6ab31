"""Helpers shared by the training-data operators: staged tables, column names that cannot clash, dense ranks."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuadre.session import ensure_checkpoint_dir

#: ASCII white space of the word definition: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that were reading the table, and values such as
    ``monotonically_increasing_id`` are fixed once written. The folder is the one named by ``spark.checkpoint.dir``;
    tables stay there until that scratch folder is cleared.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def text_or_empty(col: str):
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def ranked(df: DataFrame, order: Sequence[str], group: str | None = None, partitions: int | None = None,
           name: str = "ranked") -> DataFrame:
    """Add ``rank`` (long, from 1): the position of every row in the order of ``order``, per value of ``group``.

    No task sees a whole group: rows are range-partitioned on (group, order) and staged with their partition number,
    the partitions' row counts are summed up into offsets (a table of partitions x groups in them), and a window
    numbers the rows inside one partition only. Ties on all of ``order`` are numbered arbitrarily but only once.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group] if group else []) + list(order)
    part, off = free_names(df, "part_no", "part_offset")
    rows = stage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                 .withColumn(part, F.spark_partition_id()), name)
    by = [part] + ([group] if group else [])
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(part)
    offsets = sizes.select(*by, (F.sum("n").over(before) - F.col("n")).alias(off))
    if group:  # null is a group of its own
        g = free_names(rows, "group_key")[0]
        right = offsets.withColumnRenamed(group, g).withColumnRenamed(part, part + "_r")
        cond = F.col(part).eqNullSafe(F.col(part + "_r")) & F.col(group).eqNullSafe(F.col(g))
        joined = rows.join(right, cond).drop(g, part + "_r")
    else:
        joined = rows.join(offsets, part)
    within = Window.partitionBy(*by).orderBy(*order)
    return joined.withColumn("rank", F.row_number().over(within) + F.col(off)).drop(part, off)


def broadcast_by_value(spark, thing) -> Broadcast:
    """Broadcast an object of a bounded size whose class the executors need not have."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(shared: Broadcast):
    return pickle.loads(shared.value)
