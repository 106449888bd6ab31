"""File-stream form of the journal balance check.

The reference runs on files as they are delivered; here new ledger files landing in a folder are read by Structured
Streaming, cleaned with the same Column builders (N01 / N06) and the per-entry balance (A02) is kept as streaming
state (a built-in stateful aggregation, ``update`` mode), so each micro-batch only adds its own lines. The state is
held in the checkpoint location (shared storage on a cluster), which makes the query restartable after failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from cuadre.functions import numbers as N
from cuadre.operators.balance import DEFAULT_TOLERANCE


def ledger_stream(spark: SparkSession, folder: str, columns: list[str], sep: str = ",",
                  max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming scan of CSV ledgers with a known header (every column as text)."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return (spark.readStream.schema(schema).option("header", True).option("sep", sep)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder)
            .withColumn("file_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def streaming_entry_balance(lines: DataFrame, mapping: dict[str, str], tol: float = DEFAULT_TOLERANCE,
                            group_cols: list[str] | None = None) -> DataFrame:
    """Per-entry running balance: rename (P01), amount from debit/credit or amount text (N01/N06), then a
    stateful sum per journal id with the balanced flag (A02). ``group_cols`` names the ledger (``file_id`` where each
    file is one), so that ids of different ledgers stay apart; without it all files belong to one ledger.

    An entry may get lines at any time, so its sum stays in the state until the query is restarted on a new
    checkpoint (a close-out period); the state has one row per entry, not per line."""
    df = lines.withColumnsRenamed({k: v for k, v in mapping.items() if k in lines.columns})
    if "amount" in df.columns:
        amount = N.clean_amount("amount")
    else:
        amount = N.debit_credit_to_amount(N.clean_amount("debit_amount"), N.clean_amount("credit_amount"))
    g = group_cols or []
    df = df.select(*g, F.col("journal_entry_id"), amount.cast("decimal(18,2)").alias("amount"))
    agg = df.where(F.col("journal_entry_id").isNotNull()).groupBy(*g, "journal_entry_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("amount_sum"), F.count(F.lit(1)).alias("lines"))
    return agg.withColumn("is_balanced", F.abs(F.col("amount_sum")) < F.lit(tol))


def start_balance_query(balances: DataFrame, checkpoint: str, sink: str = "memory", name: str = "entry_balance",
                        trigger_seconds: int | None = None) -> StreamingQuery:
    """Start the balance stream in ``update`` mode (memory sink for tests; any sink with foreachBatch otherwise)."""
    w = balances.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(sink).start()
