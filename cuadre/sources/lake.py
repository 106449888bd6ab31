"""Lake scan (S02-S07): any number of ledger and report files as one plan.

A lake is two tables. ``headers`` has one row per file: its ledger, how it is read (format by extension, encoding,
delimiter) and the names of its columns. ``rows`` has one row per record with the cells as an array, in the order of its
file's names; report files (``.txt``, ``.log``, anything that is no table) have their line as the only cell. Headers are
data: they come from one aggregation over the lines (first line, delimiter counts, whether the bytes are UTF-8), and rows
meet their file's header by a join, so the plan has the same size for two files and for a thousand. Tables of one row
per file are broadcast: they are no larger than the file listing that the driver holds for the scan, and lines are never
shuffled to meet them.

``file_id`` is the ledger's path below the scanned folder: a file's path, or with ``by="folder"`` that of the folder
whose part files make up one ledger. Files of the same name in different folders are different ledgers.

Reading: UTF-8 (with or without byte order mark), Latin-1 where a file's bytes are not UTF-8, UTF-16 by its byte order
mark. The delimiter is the candidate that the file's first line has most often (outside quotes; the earlier candidate on ties). Quoted
cells may hold the delimiter and doubled quotes, but no line break. Blank lines and lines that repeat the header (as joined exports have them) are no records, missing cells are null, cells
beyond the header are dropped; an unquoted blank cell is null, a quoted one is ''. A column without a name is
``Unnamed: k`` (from 0), and a name that repeats gets ``.1``, ``.2`` and so on.
"""

from __future__ import annotations

from collections.abc import Callable
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuadre.session import cut_lineage
from cuadre.sources.io import ACCEPTED_EXTENSIONS, DELIMITERS, SIZE_WARNING_BYTES
from cuadre.sources.paths import common_folder, file_name, file_path, plain_path

TABLE_EXTENSIONS = ["csv", "tsv"]
WIDE = ["utf-16le", "utf-16be"]
#: Rows of a file's first split that are looked at for samples before the whole file is.
FIRST_ROWS = 1000
QUOTED = r'"(?:[^"]|"")*"'


@dataclass
class Lake:
    """``headers``: (file, file_id, kind, extension, accepted, size, size_warning, encoding, sep, names, lines);
    ``rows``: (file, file_id, row_order, cells); ``only``: the rows of the files in a table (file), where the lake can
    leave out the other files' lines before they are decoded and split."""

    headers: DataFrame
    rows: DataFrame
    only: Callable[[DataFrame], DataFrame] | None = None

    def rows_of(self, files: DataFrame) -> DataFrame:
        """Rows of the files in ``files`` (file), one row per file."""
        return self.only(files) if self.only else self.rows.join(F.broadcast(files), "file", "left_semi")

    def columns(self) -> DataFrame:
        """(file_id, column, ordinal) of every ledger, from its first file."""
        first = self.headers.where("kind = 'table'").groupBy("file_id").agg(F.min_by("names", "file").alias("names"))
        return first.select("file_id", F.posexplode("names").alias("i", "column")).select(
            "file_id", "column", (F.col("i") + 1).alias("ordinal"))

    def union(self, other: Lake) -> Lake:
        same = [c for c in self.headers.columns if c in other.headers.columns]
        return Lake(self.headers.select(*same).unionByName(other.headers.select(*same)), self.rows.unionByName(other.rows),
                    lambda files: self.rows_of(files).unionByName(other.rows_of(files)))

    def cells(self) -> DataFrame:
        """(file_id, column, ordinal, row_order, value) of every cell of the tables."""
        flat = self.tables().select("file_id", "row_order", F.posexplode(F.arrays_zip("names", "cells")).alias("i", "c"))
        return flat.select("file_id", F.col("c.names").alias("column"), (F.col("i") + 1).alias("ordinal"), "row_order", F.col("c.cells").alias("value"))

    def tables(self, files: DataFrame | None = None) -> DataFrame:
        """(file, file_id, row_order, cells, names) of the tables, or of those in ``files`` (file)."""
        rows = self.rows if files is None else self.rows_of(files)
        return rows.join(F.broadcast(self.headers.where("kind = 'table'").select("file", "names")), "file")

    def reports(self) -> DataFrame:
        """(file_id, file, row_order, text) of the lines of report files."""
        texts = self.rows_of(self.headers.where("kind = 'text'").select("file"))
        return texts.select("file_id", "file", "row_order", F.col("cells")[0].alias("text"))


def scan_lines(spark: SparkSession, paths: list[str], root: str, encoding: str | None = None) -> DataFrame:
    """(file, size, row_order, raw) of every line; ``raw`` are its bytes. UTF-16 needs its own line ends."""
    reader = spark.read.option("recursiveFileLookup", True)
    if encoding:
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    return reader.text(paths).select(
        file_name(root).alias("file"), file_path().alias("uri"), F.col("_metadata.file_size").alias("size"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).alias("row_order"),
        F.col("value").cast("binary").alias("raw"))


def decoded(raw: Column, encoding: Column) -> Column:
    """Text of a line without byte order mark and line end."""
    even = F.substring(raw, 1, F.octet_length(raw) - F.octet_length(raw) % 2)  # a file cut off within a character
    text = (F.when(encoding == "latin-1", F.decode(raw, "ISO-8859-1")).when(encoding == "utf-16le", F.decode(even, "UTF-16LE"))
             .when(encoding == "utf-16be", F.decode(even, "UTF-16BE")).otherwise(raw.cast("string")))
    return F.regexp_replace(text, "^﻿|\r$", "")


def split_record(line: Column, sep: Column) -> Column:
    """Cells of a record; unquoted blank cells are null."""
    one = F.concat(F.lit(rf'({QUOTED}|[^'), F.when(sep == "\t", F.lit(r"\t")).otherwise(sep), F.lit(r"]*)["), F.when(sep == "\t", F.lit(r"\t")).otherwise(sep), F.lit("]"))
    plain = F.split(line, F.when(sep == "\t", sep).otherwise(F.concat(F.lit("\\"), sep)), -1)  # nothing is quoted: cut at every delimiter
    found = F.when(F.contains(line, F.lit('"')), F.regexp_extract_all(F.concat(line, sep), one, 1)).otherwise(plain)
    return F.transform(found, lambda c: F.when(c.startswith('"') & c.rlike(r'^"(?s:.*)"$'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"')))
                       .otherwise(F.when(F.trim(c) != "", c)))


def named_cells(cells: Column) -> Column:
    """Header cells with a number in place of a blank name."""
    return F.transform(cells, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(c))


def numbered_repeats(names: Column) -> Column:
    """Names with .1, .2 after those that repeat an earlier one."""
    before = lambda c, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == c))
    return F.transform(names, lambda c, i: F.concat(c, F.when(i == 0, F.lit("")).when(before(c, i) > 0, F.concat(F.lit("."), before(c, i).cast("string"))).otherwise(F.lit(""))))


def describe_files(lines: DataFrame) -> DataFrame:
    """One row per file: (file, uri, size, first line, encoding, lines). The splits are counted by an aggregation that holds no
    line, so no line is sorted; the files' first lines are then looked up by their place."""
    place = [F.col("row_order.block").alias("block"), F.col("row_order.pos").alias("pos")]
    splits = lines.select("file", "uri", "size", *place, F.is_valid_utf8(F.col("raw").cast("string")).alias("valid")).groupBy("file", "uri", "size", "block").agg(
        F.min("pos").alias("pos"), F.bool_and("valid").alias("valid"), F.count(F.lit(1)).alias("lines"))
    files = cut_lineage(splits.groupBy("file", "uri", "size").agg(
        F.min(F.struct("block", "pos")).alias("at"), F.bool_and("valid").alias("valid"), F.sum("lines").alias("lines")))
    heads = lines.select("uri", *place, F.col("raw").alias("first")).join(F.broadcast(files.select("uri", "at.block", "at.pos")), ["uri", "block", "pos"])
    mark = F.hex(F.substring("first", 1, 4))
    encoding = (F.when(mark.startswith("FFFE"), F.lit("utf-16le")).when(mark.startswith("FEFF"), F.lit("utf-16be"))
                 .when(F.col("valid"), F.lit("utf-8")).otherwise(F.lit("latin-1")))
    return files.join(heads.select("uri", "first"), "uri").select("file", "uri", "size", "first", encoding.alias("encoding"), "lines")


def most_frequent(counts: list[Column]) -> Column:
    """The delimiter with the highest count, the earlier candidate on ties."""
    most = F.greatest(*counts)
    out = F.when(counts[0] == most, F.lit(DELIMITERS[0]))
    for c, d in zip(counts[1:], DELIMITERS[1:]):
        out = out.when(c == most, F.lit(d))
    return out


def read_lake(spark: SparkSession, paths: str | list[str], by: str = "file", root: str | None = None) -> Lake:
    """Headers (one row per file, materialised) and rows (lazy) of all files below ``paths``."""
    if by not in ("file", "folder"):
        raise ValueError("a ledger is a file or a folder")
    paths = [paths] if isinstance(paths, str) else list(paths)
    root = plain_path(root) if root else common_folder(paths)
    lines = scan_lines(spark, paths, root)
    found = cut_lineage(describe_files(lines))
    lines = lines.withColumn("read_as", F.lit(None).cast("string"))
    for e in WIDE:  # files in UTF-16 are read again with their own line ends; the reader needs their paths
        uris = [r["uri"] for r in found.where(F.col("encoding") == e).select("uri").collect()]
        if uris:
            again = scan_lines(spark, uris, root, e.upper()).withColumn("read_as", F.lit(e))
            lines = lines.unionByName(again)
            redone = again.groupBy("file").agg(F.min_by("raw", "row_order").alias("again"), F.count(F.lit(1)).alias("n"))
            found = found.join(redone, "file", "left").select("file", "uri", "size", F.coalesce("again", "first").alias("first"), "encoding",
                                                              F.coalesce("n", "lines").alias("lines"))
    # every step is a column of its own: an expression that repeats another one would be computed again
    table = F.col("extension").isin(TABLE_EXTENSIONS)
    headers = found.select("file", _ledger(F.col("file"), by).alias("file_id"), F.lower(F.regexp_extract("file", r"\.(\w+)$", 1)).alias("extension"),
                           "size", "encoding", "lines", decoded(F.col("first"), F.col("encoding")).alias("line"))
    headers = headers.withColumn("kind", F.when(table, F.lit("table")).otherwise(F.lit("text"))).withColumn("bare", F.regexp_replace("line", QUOTED, ""))
    headers = headers.withColumns({f"c{i}": F.length("bare") - F.length(F.replace("bare", F.lit(d), F.lit(""))) for i, d in enumerate(DELIMITERS)})
    headers = headers.withColumn("sep", F.when(F.col("extension") == "tsv", F.lit("\t")).when(table, most_frequent([F.col(f"c{i}") for i in range(len(DELIMITERS))])))
    headers = cut_lineage(headers.withColumn("found", F.when(table, split_record(F.col("line"), F.col("sep")))))
    headers = cut_lineage(headers.withColumn("named", named_cells(F.col("found")))).withColumn("names", numbered_repeats(F.col("named")))
    headers = cut_lineage(headers.select(
        "file", "file_id", "kind", "extension", F.col("extension").isin(*ACCEPTED_EXTENSIONS, "tsv").alias("accepted"), "size",
        (F.col("size") > SIZE_WARNING_BYTES).alias("size_warning"), "encoding", "sep", "names", "lines", "line"))

    known = headers.select("file", "file_id", "encoding", "sep", "kind", F.size("names").alias("width"), "line")
    mine = F.when(F.col("encoding").isin(WIDE), F.col("read_as") == F.col("encoding")).otherwise(F.col("read_as").isNull())

    def records(files: DataFrame) -> DataFrame:
        met = lines.join(F.broadcast(files), "file").where(F.coalesce(mine, F.lit(False)))
        met = met.withColumn("text", decoded(F.col("raw"), F.coalesce("read_as", F.when(~F.col("encoding").isin(WIDE), F.col("encoding")))))
        met = met.where((F.col("kind") == "text") | ((F.col("text") != F.col("line")) & (F.trim("text") != "")))
        cells = F.when(F.col("kind") == "table", _fitted(split_record(F.col("text"), F.col("sep")), F.col("width"))).otherwise(F.array("text"))
        order = F.struct("file", F.col("row_order.block").alias("block"), F.col("row_order.pos").alias("pos"))
        return met.select("file", "file_id", order.alias("row_order"), cells.alias("cells"))

    return Lake(headers.drop("line"), records(known), lambda files: records(known.join(F.broadcast(files), "file", "left_semi")))


def _ledger(file: Column, by: str) -> Column:
    return file if by == "file" else F.regexp_replace(file, "/[^/]*$", "")


def _fitted(cells: Column, width: Column) -> Column:
    """Cells cut or filled up with nulls to the header's width."""
    missing = F.greatest(width - F.size(cells), F.lit(0))
    return F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), missing)), F.lit(1), F.greatest(width, F.lit(1)))


def first_cells(lake: Lake, n: int = 100, first_rows: int = FIRST_ROWS) -> DataFrame:
    """W08 on wide rows: the first ``n`` non-null values of every column, (file_id, column, ordinal, value, rn).

    The first rows of a ledger hold the sample of nearly every column: only they are unpivoted and ordered. They are in
    its first files, and of a file that is longer than all of them in its first split, so nothing else is read for them. The
    columns that have fewer values there are looked up in the whole ledger, and nothing else of it is.
    """
    per = Window.partitionBy("file_id").orderBy("row_order")
    sizes = lake.headers.where("kind = 'table'").select("file", "file_id", "lines")  # a line is at most one record
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = cut_lineage(sizes.withColumn("before", before).where(F.col("before") < first_rows))
    inside = lake.tables(near.where(F.col("lines") <= first_rows).select("file"))
    longer = lake.tables(near.where(F.col("lines") > first_rows).select("file")).where("row_order.block = 0")
    early = cut_lineage(inside.unionByName(longer).withColumn("at", F.row_number().over(per)).where(F.col("at") <= first_rows))
    pairs = F.arrays_zip(F.col("names"), F.col("cells"))

    def cells(df):
        flat = df.select("file_id", "row_order", F.posexplode(pairs).alias("i", "c"))
        return flat.select("file_id", F.col("c.names").alias("column"), (F.col("i") + 1).alias("ordinal"), "row_order", F.col("c.cells").alias("value")).where("value is not null")

    def numbered(df):
        w = Window.partitionBy("file_id", "column").orderBy("row_order")
        return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("file_id", "column", "ordinal", "value", "rn")

    head = cut_lineage(numbered(cells(early)))
    had = head.groupBy("file_id", "column").agg(F.count(F.lit(1)).alias("had"))
    whole = sizes.groupBy("file_id").agg(F.sum("lines").alias("seen")).where(F.col("seen") > first_rows)  # shorter ledgers were seen whole
    short = cut_lineage(lake.columns().join(whole, "file_id").join(had, ["file_id", "column"], "left").where(F.coalesce("had", F.lit(0)) < n).select("file_id", "column"))
    if short.isEmpty():
        return head
    again = sizes.join(short.select("file_id").distinct(), "file_id", "left_semi").select("file")
    rest = numbered(cells(lake.tables(again)).join(F.broadcast(short), ["file_id", "column"], "left_semi"))
    return head.join(short, ["file_id", "column"], "left_anti").unionByName(rest)
