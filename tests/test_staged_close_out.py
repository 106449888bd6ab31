"""Close-out of a lake at size: lines read once, few rows ordered for the dates, other files left out early."""

from pyspark.sql import functions as F

from cuadre.functions import dates as D
from cuadre.operators import closeout as X
from cuadre.operators import journal as J
from cuadre.sources import catalog as C
from cuadre.sources import lake as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_journal_is_read_from_staged_rows(spark, tmp_path):
    """Before, the header, the balance and every count cut the lines, cleaned the amounts and parsed the dates again."""
    write(tmp_path / "a", "1.csv", "Asiento,FechaAsiento,Importe\n" + "".join(f"{i // 2},2024-01-{i % 28 + 1:02d},{5 if i % 2 else -5}\n" for i in range(40)))
    lake = K.read_lake(spark, str(tmp_path))
    out = X.close_lake(lake, X.map_lake(lake, C.synonyms(spark), C.field_definitions(spark)))
    for df in (out.journal, out.header, out.detail):
        assert "FileScan text" not in plan(df) and "FileScan parquet" in plan(df)
    (b,) = out.balance.collect()
    assert (b.entries_count, b.balanced_entries_count, b.rows) == (20, 20, 40)
    assert out.journal.agg(F.min("posting_date"), F.max("posting_date")).first()[:] == ("2024-01-01", "2024-01-28")


def test_first_dates_are_looked_for_in_few_blocks(spark):
    """Dates that begin late, twice in one ledger, or are too few: the same decisions as from all rows."""
    at = "struct<file:string,block:bigint,pos:bigint>"
    n = 3 * X.BLOCK_ROWS
    rows = [("a", ("a", 0, i), f"{i % 28 + 1:02d}/01/2024 10:00" if i >= n - 20 else None, None, "2024-01-05") for i in range(n)]
    rows += [("b", ("b", k % 2, 7 * k), "10:30" if k > 5 else "", "x" if k == 3 else None, None) for k in range(9)]
    df = spark.createDataFrame(rows, f"file_id string, row_id {at}, entry_date string, entry_time string, posting_date string").repartition(3)
    some = X.first_dated(df)
    assert some.where("file_id = 'a'").count() <= 2 * X.BLOCK_ROWS
    key = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    assert key(D.date_decisions(df, J.DATE_FIELDS, "row_id", ["file_id"], first=some)) == key(D.date_decisions(df, J.DATE_FIELDS, "row_id", ["file_id"]))


def test_files_are_left_out_before_their_lines_are_cut(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n3,4\n")
    write(tmp_path, "b.csv", "x;y\n5;6\n")
    write(tmp_path, "c.txt", "line, one\n")
    lake = K.read_lake(spark, str(tmp_path))
    some = lake.union(K.Lake(lake.headers, lake.rows)).rows_of(lake.headers.where("file like 'a%'").select("file"))
    assert sorted(r.cells for r in some.collect()) == [["1", "2"], ["1", "2"], ["3", "4"], ["3", "4"]]
    text = lake.rows_of(lake.headers.where("file = 'b.csv'").select("file"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(text) if "LeftSemi" in x) > next(i for i, x in enumerate(text) if "regexp_replace" in x)


def test_entries_are_summed_once(spark):
    """Before, ``close_out`` cleaned and summed every row twice: for the report and for the counts."""
    headers = spark.createDataFrame([("f", "f", "table", ["Asiento", "Importe"])], "file string, file_id string, kind string, names array<string>")
    cells = spark.createDataFrame([("f", "f", str(i), [str(i // 2), f"{(-1) ** i * 3},50"]) for i in range(6)], "file string, file_id string, row_order string, cells array<string>")
    maps = spark.createDataFrame([("f", "Asiento", "journal_entry_id", 0.9, ""), ("f", "Importe", "amount", 0.9, "")],
                                 "file_id string, column string, field_type string, confidence double, resolution_type string")
    out = X.close_out_rows(K.Lake(headers, cells), maps)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in text and text.count("parquet") == 2
    (r,) = out.collect()
    assert (r.rows, r.rows_with_amount, r.entries_count, r.balanced_entries_count) == (6, 6, 3, 3)
