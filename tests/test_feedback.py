"""Decisions merged into versioned catalogue and pattern tables, and what the patterns then find."""

from pyspark.sql import functions as F

from cuadre.operators import mapping as M
from cuadre.operators import profile as P
from cuadre.operators import review as RV
from cuadre.sources import catalog as C
from cuadre.sources import versions as V

SAMPLE = "file_id string, column string, ordinal int, value string, rn int"


def sample_of(spark, columns):
    return spark.createDataFrame([(f, c, o, v, rn) for f, c, o, vals in columns for rn, v in enumerate(vals, 1)], SAMPLE)


def test_versions_commit_once_per_run(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("x", 1)], [("x", 2), ("y", 3)]))
    assert V.current_version(spark, path) == 0 and V.read_current(spark, path, a.limit(0)).count() == 0
    assert (V.commit(a, path, V.run_id(a)), V.commit(b, path, V.run_id(b)), V.commit(b, path, V.run_id(b)), V.commit(a, path, V.run_id(a))) == (1, 2, 2, 1)
    assert V.current_version(spark, path) == 2 and sorted(map(tuple, V.read_current(spark, path, a).collect())) == [("x", 2), ("y", 3)]
    assert V.run_id(b) == V.run_id(b.orderBy(F.desc("k"))) != V.run_id(a)


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    a.union(a).write.parquet(f"{path}/versions/1")  # a job that ended before the pointer was written
    assert V.current_version(spark, path) == 0 and V.commit(a, path, "r") == 1 and V.read_current(spark, path, a).count() == 1


def test_feedback_teaches_catalogue_and_patterns(spark, tmp_path):
    taught = [("a", "Ref", 1, [f"AB-{i:04d}" for i in range(12)]), ("a", "Importe", 2, [f"{i}.5" for i in range(12)])]
    other = [("b", "Clave", 1, [f"ZX-{i:04d}" for i in range(9)] + ["?"]), ("b", "Otro", 2, [f"Z{i}" for i in range(10)])]
    sample = sample_of(spark, taught + other)
    columns = sample.select("file_id", "column", "ordinal").distinct()
    seed = C.synonyms(spark)
    best = M.best_matches(sample, columns, seed, C.field_definitions(spark))
    vals = P.validator_scores(sample)
    queue = RV.review_queue(columns.where("file_id = 'a'"), best.where("file_id = 'a'").drop("ordinal"), RV.alternatives(vals, best, sample))
    decisions = spark.createDataFrame([("a", "Ref", "manual", "vendor_id"), ("a", "Importe", "reject", None)], "file_id string, column string, choice string, chosen_field string")
    cat, pat = str(tmp_path / "cat"), str(tmp_path / "pat")
    assert RV.merge_feedback(queue, decisions, sample, seed, cat, pat) == (1, 1)
    assert RV.merge_feedback(queue, decisions, sample, seed, cat, pat) == (1, 1)  # again: nothing new
    now = V.read_current(spark, cat, seed)
    rows = lambda t: {(r.field_type, r.erp, r["name"], bool(r.deprecated)) for r in t.collect()}
    assert rows(now) - rows(seed) == {("vendor_id", "Generic_ES", "Ref", False), ("amount", "Generic_ES", "Importe", True)}
    assert now.count() == seed.count() + 1
    patterns = spark.read.parquet(f"{pat}/versions/1")
    assert [(r.field_type, r.regex, r.sample_values[0]) for r in patterns.collect()] == [("vendor_id", r"^[A-Z]{2}[.,:;\-_/]{1}\d{4}$", "AB-0000")]
    learned = P.learned_pattern_scores(sample, patterns)
    assert {(r.file_id, r["column"]): round(r.score, 3) for r in learned.collect()} == {("a", "Ref"): 1.0, ("b", "Clave"): 0.9}
    before = {(r.file_id, r["column"], r.field_type): r.confidence for r in M.merge_candidate_sources(best, vals).collect()}
    after = {(r.file_id, r["column"], r.field_type): (r.confidence, r.source) for r in M.merge_candidate_sources(best, vals, learned).collect()}
    assert after["b", "Clave", "vendor_id"][0] == 0.9 and before.get(("b", "Clave", "vendor_id"), 0) < 0.9
    assert {k: v[0] for k, v in after.items() if "learned" not in v[1]} == {k: v for k, v in before.items() if "learned" not in after[k][1]}
    assert P.learned_pattern_scores(sample, patterns.limit(0)).count() == 0

    second = spark.createDataFrame([("a", "Ref", "manual", "vendor_id")], decisions.schema)
    assert RV.merge_feedback(queue, second, sample, seed, cat, pat) == (2, 2)  # the pattern is seen again: more certain
    assert round(V.read_current(spark, pat, patterns).first().confidence, 2) == 0.85
