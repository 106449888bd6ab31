"""Samples, balance trial and close-out on wide rows: first rows by a limit, no exchange keyed by row."""

import pytest
from pyspark.sql import functions as F

from cuadre.operators import closeout as X
from cuadre.operators import profile as P
from cuadre.sources import lake as K

BEST = "file_id string, column string, ordinal int, field_type string, confidence double"
MAPS = "file_id string, column string, field_type string, confidence double, resolution_type string"


def as_lake(spark, rows, names, file="f"):
    headers = spark.createDataFrame([(file, file, "table", names)], "file string, file_id string, kind string, names array<string>")
    cells = spark.createDataFrame([(file, file, str(i), r) for i, r in enumerate(rows)], "file string, file_id string, row_order string, cells array<string>")
    return K.Lake(headers, cells)


@pytest.mark.parametrize("size", [60, 10])
def test_first_rows_then_the_whole_file(spark, size):
    rows = [(i, f"a{i}", f"late{i}" if i >= 30 else None, f"x{i}" if i % 9 == 0 else None, None) for i in reversed(range(size))]
    df = spark.createDataFrame(rows, "k int, always string, late string, some string, never string").repartition(5)
    names = ["always", "late", "some", "never"]
    key = lambda d: sorted((r["column"], r.ordinal, r.rn, r.value) for r in d.collect())
    got = key(P.first_of_file(df, "f", F.col("k"), names, n=4, first_rows=20))
    assert got == key(P.first_values(P.cells(df, "f", F.col("k"), names), 4))
    assert [g for g in got if g[0] == "late"] == ([("late", 2, j + 1, f"late{30 + j}") for j in range(4)] if size > 30 else [])


def test_close_out_counts_repeated_rows(spark):
    lake = as_lake(spark, [["1", "10,00"], ["1", "-10,00"], ["2", "5,00"], ["2", "5,00"], [None, "3,00"]], ["Asiento", "Importe"])
    maps = spark.createDataFrame([("f", "Asiento", "journal_entry_id", 0.9, ""), ("f", "Importe", "amount", 0.9, "")], MAPS)
    (r,) = X.close_out_rows(lake, maps).collect()
    assert (r.rows, r.rows_with_amount, r.entries_count, r.balanced_entries_count, float(r.total_amount_sum)) == (5, 5, 2, 1, 13.0)


def test_queries_move_entries_not_rows(spark):
    """Before, cells met on (file_id, row_key): two exchanges of the whole ledger."""
    import __spark_entry__ as E

    for name in ("balance_trial", "close_out"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert moved and not any("row_key" in x for x in moved), name


def test_sample_of_many_files_reads_the_first(spark, tmp_path):
    """A ledger of small files and a long one in several splits, a column that is filled late, a short ledger."""
    many = tmp_path / "many"
    many.mkdir()
    n = 0
    for k, size in enumerate((5, 3, 400, 40)):
        with open(many / f"p{k}.csv", "w") as f:
            f.write("k,always,late\n")
            for _ in range(size):
                f.write(f"{n},a{n},{f'late{n}' if n >= 200 else ''}\n")
                n += 1
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "p.csv").write_text("k,z\n1,q\n2,\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lake = K.read_lake(spark, str(tmp_path), by="folder")
        got = {}
        for r in K.first_cells(lake, n=4, first_rows=20).orderBy("rn").collect():
            got.setdefault((r.file_id, r["column"]), []).append(r.value)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("many", "k"): ["0", "1", "2", "3"], ("many", "always"): ["a0", "a1", "a2", "a3"],
                   ("many", "late"): ["late200", "late201", "late202", "late203"], ("one", "k"): ["1", "2"], ("one", "z"): ["q"]}
