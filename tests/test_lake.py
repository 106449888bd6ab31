"""Lake scan, close-out on wide rows, text reports as ledgers."""

import os

from pyspark.sql import functions as F

from cuadre.operators import closeout as X
from cuadre.operators import reports as R
from cuadre.sources import catalog as C
from cuadre.sources import lake as K


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


def test_headers_and_records(spark, tmp_path):
    d = str(tmp_path)
    write(d, "2024/libro.csv", 'Asiento,Importe,Importe,,"a ""q"", x"\n1,"1.234,50",,x,y\n\nAsiento,Importe,Importe,,"a ""q"", x"\n2,3\n3,"",4,5,6,7\n')
    write(d, "2025/libro.csv", "Año;Descripción\r\n2024;niño\r\n", "latin-1")
    write(d, "2025/u16 b+c.csv", "﻿Nº|Débito\n1|Ċa\n2|b\n", "utf-16le")
    write(d, "2025/be.tsv", "﻿Nº\tDébito\n1\tĊa\n", "utf-16be")
    write(d, "bom.csv", "﻿x,y\n1,2\n")
    write(d, "r.txt", "one\n\n  two, x\n")
    lake = K.read_lake(spark, d)
    heads = {r.file_id: r for r in lake.headers.collect()}
    assert {k: (h.kind, h.sep, h.encoding, h.names) for k, h in heads.items()} == {
        "2024/libro.csv": ("table", ",", "utf-8", ["Asiento", "Importe", "Importe.1", "Unnamed: 3", 'a "q", x']),
        "2025/libro.csv": ("table", ";", "latin-1", ["Año", "Descripción"]),
        "2025/u16 b+c.csv": ("table", "|", "utf-16le", ["Nº", "Débito"]),
        "2025/be.tsv": ("table", "\t", "utf-16be", ["Nº", "Débito"]),
        "bom.csv": ("table", ",", "utf-8", ["x", "y"]), "r.txt": ("text", None, "utf-8", None)}
    got = {}
    for r in lake.rows.orderBy("row_order").collect():
        got.setdefault(r.file_id, []).append(r.cells)
    assert got == {"2024/libro.csv": [["1", "1.234,50", None, "x", "y"], ["2", "3", None, None, None], ["3", "", "4", "5", "6"]],
                   "2025/libro.csv": [["2024", "niño"]], "2025/u16 b+c.csv": [["1", "Ċa"], ["2", "b"]], "2025/be.tsv": [["1", "Ċa"]],
                   "bom.csv": [["1", "2"]], "r.txt": [["one"], [""], ["  two, x"]]}
    folders = K.read_lake(spark, [os.path.join(d, "2024"), os.path.join(d, "2025")], by="folder")
    assert {r.file_id for r in folders.headers.collect()} == {"2024", "2025"}


def test_plan_does_not_grow_with_the_files(spark, tmp_path):
    sizes = []
    for n in (2, 300):
        d = str(tmp_path / str(n))
        for i in range(n):
            write(d, f"{i}/libro.csv", ",".join(f"c{i}_{k}" for k in range(i % 7 + 1)) + "\n" + ",".join("x" * (i % 7 + 1)) + "\n")
        lake = K.read_lake(spark, d)
        assert lake.headers.select("names").distinct().count() == n and lake.rows.count() == n
        sizes.append(len(lake.tables()._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_samples_of_sparse_columns(spark, tmp_path):
    write(str(tmp_path), "a.csv", "id,rare\n" + "".join(f"{i},{i if i % 10 == 9 else ''}\n" for i in range(100)))
    lake = K.read_lake(spark, str(tmp_path))
    got = [(r["column"], r.rn, r.value) for r in K.first_cells(lake, n=4, first_rows=20).orderBy("ordinal", "rn").collect()]
    assert got == [("id", k + 1, str(k)) for k in range(4)] + [("rare", k + 1, str(10 * k + 9)) for k in range(4)]


def close(spark, d, **kw):
    lake = K.read_lake(spark, d, **kw)
    return X.close_lake(lake, X.map_lake(lake, C.synonyms(spark), C.field_definitions(spark)))


def test_scenarios_dates_and_header(spark, tmp_path):
    d = str(tmp_path)
    write(d, "2024/libro.csv", "Asiento,FechaEntrada,Importe\n" + "".join(f"{i // 2},{i % 28 + 1:02d}/01/2024 10:{i % 60:02d},\"{'-' if i % 2 else ''}{i // 2 + 1}.000,50\"\n" for i in range(40)))
    write(d, "2025/libro.csv", "Asiento;Debe;Haber\n" + "".join(f"{i // 2};{'' if i % 2 else f'{i // 2 + 1},25'};{f'{i // 2 + 1},25' if i % 2 else ''}\n" for i in range(38)) + "77;9,00;\n")
    write(d, "sap.tsv", "BELNR\tBUDAT\tDMBTR\tSHKZG\n" + "".join(f"{i}\t202401{i % 28 + 1:02d}\t{i + 1}.125\tS\n" for i in range(30)))
    out = close(spark, d)
    bal = {r.file_id: r for r in out.balance.collect()}
    assert {k: (r.amount_scenario, r.entries_count, r.balanced_entries_count, r.rows) for k, r in bal.items()} == {
        "2024/libro.csv": (2, 20, 20, 40), "2025/libro.csv": (1, 20, 19, 39), "sap.tsv": (3, 30, 0, 30)}
    assert abs(float(bal["sap.tsv"].total_amount_sum) - sum(round(i + 1.13, 2) for i in range(30))) < 1e-6  # plain numbers pass as they are
    rows = [r for r in out.journal.orderBy("row_id").collect() if r.file_id == "2024/libro.csv"]
    assert (rows[1].entry_date, rows[1].entry_time, float(rows[1].amount), rows[1].debit_credit_indicator) == ("2024-01-02", "10:01", -1000.5, "H") or \
        (rows[1].entry_date, rows[1].entry_time) == ("2024-01-02", "10:01:00")
    assert out.header.groupBy("file_id").count().collect() and out.header.count() == 70 and out.detail.count() == 109


def test_no_exchange_by_row(spark, tmp_path):
    write(str(tmp_path), "a.csv", "Asiento,Importe\n1,2\n")
    out = close(spark, str(tmp_path))
    plan = out.balance._jdf.queryExecution().executedPlan().toString()
    assert "row_key" not in plan and "row_order" not in [w for line in plan.splitlines() if "Exchange" in line for w in line.replace(",", " ").split()]


REPORT = """------------------------------------------
Nº act.   Fecha doc.  Texto
    Lin  Cuenta       Debe       Haber
------------------------------------------
{entries}"""


def test_report_to_close_out(spark, tmp_path):
    entries, label = [], []
    for k in range(30):
        entries.append(f"{k + 1:08d}  {k % 28 + 1:02d}.01.2024  Cobro {k}")
        entries.append(f"      1  4300{k:04d} {f'{k + 1}.068,28':>10}")
        entries.append(f"      2  5700{k:04d} {'':>10} {f'{k + (2 if k == 7 else 1)}.068,28':>10}")
        label += ["PARENT", "CHILD", "CHILD"]
    write(str(tmp_path), "inf/diario.txt", REPORT.format(entries="\n".join(entries)) + "\n")
    write(str(tmp_path), "a.csv", "Asiento,Importe\n" + "".join(f"{i // 2},{5 if i % 2 else -5}\n" for i in range(20)))
    labels = ["OTHER", "HEADER", "HEADER", "OTHER", *label]
    tagged = lambda lines: lines.withColumn("predicted_label", F.get(F.array(*map(F.lit, labels)), F.col("line_no").cast("int") - 1))
    syn = C.SYNONYMS + [("journal_entry_id", "Generic_ES", "Nº act", 0.95), ("posting_date", "Generic_ES", "Fecha doc", 0.9), ("line_number", "Generic_ES", "Lin", 0.9)]
    lake = K.read_lake(spark, str(tmp_path))
    rep = R.report_lake(tagged(R.report_lines(lake)), "predicted_label")
    assert rep.headers.first().names == ["Nº act", "Fecha doc", "Texto", "Lin", "Cuenta", "Debe", "Haber"]
    cells = [r.cells for r in rep.rows.orderBy("row_order").collect()]
    assert cells[:2] == [["00000001", "01.01.2024", "Cobro 0", "1", "43000000", "1.068,28", None], ["00000001", "01.01.2024", "Cobro 0", "2", "57000000", None, "1.068,28"]]
    out = X.raw_files_to_close_out(spark, str(tmp_path), C.synonyms(spark, syn), C.field_definitions(spark), tagged)
    bal = {r.file_id: (r.entries_count, r.balanced_entries_count, r.rows, float(r.total_amount_sum)) for r in out.balance.collect()}
    assert bal == {"inf/diario.txt": (30, 29, 60, -1000.0), "a.csv": (10, 10, 20, 0.0)}
