"""Catalogue operators (U02-U05, A32, J11): the catalogue is a set of small tables; changes produce a new version
by anti-join + union (latest wins), never in-place mutation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_synonyms(synonyms: DataFrame, erp: str | None = None, include_deprecated: bool = False) -> DataFrame:
    """Distinct synonym names (optionally of one ERP, optionally with deprecated ones)."""
    s = synonyms if include_deprecated else synonyms.where(~F.coalesce("deprecated", F.lit(False)))
    if erp:
        s = s.where(F.col("erp") == erp)
    return s.select("field_type", "name").distinct()


def distinct_values(synonyms: DataFrame, col: str) -> DataFrame:
    """Distinct ERPs or field types, sorted."""
    return synonyms.select(col).distinct().orderBy(col)


def standard_and_mapped(standard: DataFrame, mappings: DataFrame) -> DataFrame:
    """Sorted union of standard fields and mapped field types."""
    return standard.select("field_type").union(mappings.select("field_type")).distinct().orderBy("field_type")


def upsert_synonyms(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Add / update synonyms; (field_type, erp, lower(name)) is the key, the change wins; rows with
    ``remove = true`` in ``changes`` delete the key. Returns the new catalogue version."""
    key = ["field_type", "erp", "__k"]
    cur = current.withColumn("__k", F.lower(F.trim("name")))
    chg = changes.withColumn("__k", F.lower(F.trim("name")))
    keep = cur.join(chg.select(*key), key, "left_anti")
    add = chg.where(~F.coalesce(F.col("remove"), F.lit(False))).drop("remove") if "remove" in chg.columns else chg
    cols = [c for c in current.columns]
    return keep.select(*cols).unionByName(add.select(*cols))


def learned_synonyms(mappings: DataFrame, current: DataFrame, boost: float = 0.8,
                     erp: str = "Generic_ES") -> DataFrame:
    """X06 learning step as data: mapped column names that are not yet synonyms of their field become new synonyms
    (case-insensitive check), ready for ``upsert_synonyms``."""
    known = current.select("field_type", F.lower(F.trim("name")).alias("__k"))
    cand = mappings.select("field_type", F.col("column").alias("name")).distinct() \
                   .withColumn("__k", F.lower(F.trim("name")))
    new = cand.join(known, ["field_type", "__k"], "left_anti").drop("__k")
    order = F.lit(10_000) + F.pmod(F.xxhash64("field_type", "name"), F.lit(1_000_000))
    return new.select("field_type", F.lit(erp).alias("erp"), "name", F.lit(boost).alias("boost"),
                      order.cast("int").alias("syn_order"),
                      F.lit(None).cast("string").alias("language"), F.lit(False).alias("deprecated"))


def catalogue_stats(synonyms: DataFrame) -> DataFrame:
    """Synonyms per field and ERP with the mean boost."""
    return synonyms.groupBy("field_type", "erp").agg(F.count(F.lit(1)).alias("synonyms"),
                                                     F.avg("boost").alias("mean_boost"))


def display_names(df: DataFrame, fields: DataFrame, col: str = "field_type") -> DataFrame:
    """Field type -> catalogue display name, else the code itself."""
    f = fields.select(F.col("field_type").alias("__f"), F.col("display_name"))
    return df.join(f, df[col] == f["__f"], "left").drop("__f") \
             .withColumn("display_name", F.coalesce("display_name", F.col(col)))
