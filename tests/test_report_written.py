"""Lake scan at size: the written report's table moves and its text does not, no line is sorted for the headers."""

import datetime as dt

from cuadre.plans import q_lake as Q
from cuadre.sources import lake as K

LINEITEM = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
            "l_returnflag string, l_linestatus string, l_shipdate timestamp")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_moves_the_table_and_not_its_text(spark):
    """Before, the rendered lines and their order keys were sorted by a shuffle, five lines more for every entry."""
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(2, 20, 1, 1, 1.0, 1234.5, 0.0, 0.0, "N", "O", day(9)), (1, 11, 1, 2, 1.0, 7.0, 0.0, 0.0, "N", "F", day(5)), (1, 10, 1, 1, 1.0, 5.0, 0.0, 0.0, "N", "O", day(6)),
            (1, 10, 1, 1, 1.0, 5.0, 0.0, 0.0, "N", "O", day(6)), (None, 30, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", None)]
    li = spark.createDataFrame(rows, LINEITEM).repartition(3)
    out = Q.labelled_report(li.repartitionByRange(2, "l_orderkey"))
    got = [(r.entry, r.seq.part, r.text, r.label) for r in out.collect()]
    assert got == [(r.entry, r.seq.part, r.text, r.label) for r in out.orderBy("entry", "seq").collect()]
    assert [g[1] for g in got] == [-4, -3, -2, 0, 1, 2, -4, -3, -2, 0, 1, 1, 1, 1, 2, -4, -3, -2, 0, 1, 2]
    own = [g for g in got if g[0] == 1]
    assert [o[2] for o in own[:3]] == [Q.RULE, Q.PARENT_HEAD, Q.CHILD_HEAD] and own[-1][2] == "Lineas del asiento: 4"
    assert own[3] == (1, 0, "1           05/01/2024  Cobros por tarjeta", "PARENT")
    assert [o[2].split() for o in own[4:8]] == [["1", "10", "5,00"], ["1", "10", "5,00"], ["2", "11", "7,00"], ["2", "11", "7,00"]]
    moved = plan(Q.labelled_report(li.repartitionByRange(2, "l_orderkey")))
    assert moved.count("rangepartitioning(l_orderkey") == 1 and "hashpartitioning" not in moved


def test_no_line_is_sorted_for_the_headers(spark, tmp_path):
    """Before, the first line of a file was found by sorting all lines of all files (189 MB spilled for 734 MB of text)."""
    (tmp_path / "a.csv").write_text("h,i\n" + "x,y\n" * 5)
    (tmp_path / "b.txt").write_text("\n\nend")
    found = K.describe_files(K.scan_lines(spark, [str(tmp_path)], str(tmp_path)))
    assert sorted((r.file, bytes(r["first"]).decode(), r.encoding, r.lines) for r in found.collect()) == [("a.csv", "h,i", "utf-8", 6), ("b.txt", "", "utf-8", 3)]
    lines = spark.createDataFrame([("f", "u", 1, (k // 5, 9 - k), bytearray(b"l%d" % k)) for k in range(10)] + [("g", "v", 1, (0, 3), bytearray(b"\xf1a"))],
                                  "file string, uri string, size long, row_order struct<block:bigint,pos:bigint>, raw binary")
    assert sorted((r.file, bytes(r["first"]), r.encoding, r.lines) for r in K.describe_files(lines).collect()) == [("f", b"l4", "utf-8", 10), ("g", b"\xf1a", "latin-1", 1)]
    assert "SortAggregate" not in plan(K.describe_files(lines))
