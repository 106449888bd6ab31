"""Whole-column counts: exact, for any text, and no cell moves on its own."""

from pyspark.sql import functions as F

from cuadre.operators import distinct as K
from cuadre.operators import profile as P


def test_counts_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 50)
    texts = ["", "a", "A", "ñ", "ñ ", "日本", "0", "00", "x" * 2000]
    rows = [(i, texts[i % len(texts)], None if i % 3 else f"v{i % 40}", None, "same", float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t string, some string, never string, hot string, `x.y` double").repartition(3)
    empty = spark.createDataFrame([], "k int, z string")
    got = {(r.file_id, r["column"]): (r.ordinal, r.rows, r.nonnull, r.distinct_values, r.null_pct)
           for r in P.whole_column_counts([("f", df, F.col("k")), ("e", empty, F.col("k"), ["z"]), ("g", df, F.col("k"), ["hot", "t"])]).collect()}
    want = {}
    for fid, cols in (("f", df.columns), ("g", ["hot", "t"])):
        for i, c in enumerate(cols):
            v = [r[df.columns.index(c)] for r in rows]
            there = [x for x in v if x is not None]
            want[fid, c] = (i + 1, len(v), len(there), len(set(there)), round((len(v) - len(there)) * 100.0 / len(v), 2))
    assert got == want


def test_many_values_meet_in_shards(spark):
    df = spark.range(0, 60000, 1, 6).select((F.col("id") % 20011).cast("string").alias("a"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("b"))
    got = {r["column"]: r.distinct_values for r in P.whole_column_counts([("f", df, F.col("a"))]).collect()}
    assert got == {"a": 20011, "b": 60000}


def test_cells_do_not_move_one_by_one(spark):
    """Before, every (column, value) of a task was a row of the exchange, after a map of all of them."""
    import __spark_entry__ as E

    plan = E.queries()["column_coverage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert any("shard" in k for k in keys) and not any("value" in k for k in keys)
