"""Conflict fold, final winners and the balance trial against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cuadre.operators import balance as B
from cuadre.operators import journal as J
from cuadre.operators import mapping as M
from cuadre.operators import review as R
from cuadre.sources import catalog as C

BEST = "file_id string, column string, ordinal int, field_type string, confidence double"


def frames(spark, rows, better=(), quality=()):
    best = spark.createDataFrame([("f", c, i, t, x) for i, (c, t, x) in enumerate(rows, 1)], BEST)
    flags = spark.createDataFrame([("f", c, True) for c in better], "file_id string, column string, better_amount boolean")
    trial = spark.createDataFrame([("f", c, q) for c, q in quality], "file_id string, column string, quality double")
    return best, flags, trial


def resolved(spark, rows, better=(), quality=None):
    best, flags, trial = frames(spark, rows, better, quality or ())
    out = M.resolve_conflicts(best, flags, trial if quality is not None else None).collect()
    return {r.field_type: (r.column, r.confidence, r.resolution_type) for r in out}


def test_amount_words_come_first_and_margin(spark):
    # the amount-named column is processed first although it stands later; 0.2 more confidence is needed
    got = resolved(spark, [("codigo", "vendor_id", 0.9), ("saldo proveedor", "vendor_id", 0.8)])
    assert got["vendor_id"] == ("saldo proveedor", 0.8, "no_conflict")
    got = resolved(spark, [("uno", "line_number", 0.5), ("dos", "line_number", 0.69), ("tres", "line_number", 0.71)])
    assert got["line_number"] == ("tres", 0.71, "highest_confidence")


def test_more_specific_name_is_kept_but_confidence_decides(spark):
    rows = [("dia", "posting_date", 0.9), ("fecha date", "posting_date", 0.8)]
    assert resolved(spark, rows)["posting_date"] == ("dia", 0.9, "highest_confidence")


def test_amount_better_candidate_and_local_rule(spark):
    rows = [("importe", "amount", 0.9), ("total", "amount", 0.8)]
    assert resolved(spark, rows)["amount"] == ("importe", 0.9, "no_conflict")
    assert resolved(spark, rows, better=["total"])["amount"] == ("importe", 0.9, "highest_confidence")
    rows = [("importe", "amount", 0.9), ("importe local", "amount", 0.8), ("saldo ml", "amount", 0.95)]
    got = resolved(spark, rows, better=["importe local", "saldo ml"])
    assert got["amount"] == ("importe local", 0.8, "amount_local_priority")


def test_forced_header_only_once(spark):
    rows = [("descripcion", "description", 0.99), ("Header description", "line_description", 0.6), ("cabecera description", "vendor_id", 0.7)]
    got = resolved(spark, rows)
    assert got["description"][:2] == ("Header description", 0.95)
    assert got["vendor_id"] == ("cabecera description", 0.7, "no_conflict") and "line_description" not in got


def test_journal_id_by_balance(spark):
    rows = [("Transaction No_", "journal_entry_id", 0.95), ("Entry No_", "journal_entry_id", 0.9)]
    assert resolved(spark, rows)["journal_entry_id"] == ("Transaction No_", 0.95, "no_conflict")
    got = resolved(spark, rows, quality=[("Transaction No_", 0.1), ("Entry No_", 1.0)])
    assert got["journal_entry_id"] == ("Entry No_", 0.9, "balance_validation_winner")
    got = resolved(spark, [("a", "journal_entry_id", 0.9), ("b", "journal_entry_id", 0.95)], quality=[("a", 1.0), ("b", 1.0)])
    assert got["journal_entry_id"] == ("b", 0.95, "balance_validation_winner")  # equal balance: the confidence decides


def brute(rows, better, quality):
    words = M.AMOUNT_PRIORITY_WORDS
    best = [(i, c, t, x) for i, (c, t, x) in enumerate(rows, 1)]
    head = next((c for _, c, _, _ in best if ("cabecera" in c.lower() or "header" in c.lower()) and "description" in c.lower()), None)
    best = [(i, c, "description", 0.95) if c == head else (i, c, t, x) for i, c, t, x in best]
    order = sorted(best, key=lambda r: (0 if r[1] == head else 1 if any(w in r[1].lower() for w in words) else 2, r[0]))
    kept = {}
    spec = lambda c, t: sum(k in c.lower() for k in M.SPECIFICITY_KEYWORDS.get(t, ()))
    trial = lambda c, x: 0.7 * quality.get(c, x) + 0.3 * x
    for _, c, t, x in order:
        if t not in kept:
            kept[t] = [(c, x)]
            continue
        cur, conf = kept[t][-1]
        if t == "journal_entry_id":
            wins = trial(c, x) > trial(cur, conf)
        else:
            wins = x > conf + 0.2 or (c in better if t == "amount" else spec(c, t) > spec(cur, t))
        if wins:
            kept[t].append((c, x))
    out = {}
    for t, k in kept.items():
        local = [e for e in k if any(m in e[0].lower() for m in M.LOCAL_AMOUNT_MARKERS)] if t == "amount" else []
        if len(k) == 1:
            out[t] = (*k[0], "no_conflict")
        elif local:
            out[t] = (*local[0], "amount_local_priority")
        elif t == "journal_entry_id" and any(c in quality for c, _ in k):
            out[t] = (*max(k, key=lambda e: (quality.get(e[0], 0.0), e[1])), "balance_validation_winner")
        else:
            out[t] = (*max(k, key=lambda e: e[1]), "highest_confidence")
    return out


def test_fold_against_plain_python(spark):
    rng = random.Random(3)
    names = ["importe", "importe local", "saldo total", "fecha", "fecha date", "asiento", "asiento journal", "cuenta", "Header description",
             "header description 2", "x1", "x2", "x3", "proveedor vendor"]
    fields = ["amount", "posting_date", "journal_entry_id", "vendor_id", "description"]
    for _ in range(12):
        cols = rng.sample(names, 9)
        rows = [(c, rng.choice(fields), rng.choice([0.3, 0.5, 0.7, 0.75, 0.9, 0.95])) for c in cols]
        better = [c for c in cols if rng.random() < 0.4]
        quality = {c: rng.choice([0.0, 0.5, 1.0]) for c, t, _ in rows if t == "journal_entry_id"}
        assert resolved(spark, rows, better, list(quality.items())) == brute(rows, better, quality)


def test_balance_trial_on_cells(spark):
    """European amounts, two ids of which one balances, debit and credit instead of an amount, one id only."""
    wide = {"f1": (["Transaction", "Entry", "Amount"], [(1, 1, "1.000,50"), (2, 1, "-1.000,50"), (2, 2, "7"), (1, 2, "-7"), (3, None, "5")]),
            "f2": (["A", "B", "Debe", "Haber"], [("x", "p", "10", ""), ("x", "q", "", "10"), ("y", "p", "3", "0"), ("y", "q", "0", "3")]),
            "f3": (["Only", "Amount"], [("x", "1")])}
    cells = spark.createDataFrame([(f, c, str(r), None if v is None else str(v)) for f, (cols, rows) in wide.items()
                                   for r, row in enumerate(rows) for c, v in zip(cols, row)], "file_id string, column string, row_key string, value string")
    best = spark.createDataFrame([("f1", "Transaction", 1, "journal_entry_id", 0.95), ("f1", "Entry", 2, "journal_entry_id", 0.9),
                                  ("f2", "A", 1, "journal_entry_id", 0.8), ("f2", "B", 2, "journal_entry_id", 0.8), ("f3", "Only", 1, "journal_entry_id", 0.9)], BEST)
    amounts = spark.createDataFrame([("f1", "Amount", "amount", 0.9, ""), ("f2", "Debe", "debit_amount", 0.9, ""), ("f2", "Haber", "credit_amount", 0.9, ""),
                                     ("f3", "Amount", "amount", 0.9, ""), ("f1", "Entry", "amount", 0.5, "")],
                                    "file_id string, column string, field_type string, confidence double, resolution_type string")
    got = {(r.file_id, r.column): r.quality for r in M.balance_trial(cells, best, M.trusted_amounts(amounts)).collect()}
    assert got == {("f1", "Transaction"): pytest.approx(0.0), ("f1", "Entry"): 1.0, ("f2", "A"): 1.0, ("f2", "B"): 0.0}


def test_conflict_ledger_end_to_end(spark):
    import __spark_entry__ as E

    got = {r.field_type: r for r in E.queries()["map_columns_conflicts"](spark, "/root/testdata/sf0.001").collect()}
    assert (got["journal_entry_id"].column, got["journal_entry_id"].resolution_type) == ("Asiento", "balance_validation_winner")
    assert (got["amount"].column, got["amount"].resolution_type) == ("Importe Local", "amount_local_priority")
    assert (got["description"].column, got["description"].confidence) == ("Header description", 0.95)
    assert got["posting_date"].resolution_type == "highest_confidence"


def test_erp_hint_raises_own_synonyms(spark):
    cols = spark.createDataFrame([("f", c, i) for i, c in enumerate(["BELNR", "BUKRS", "HKONT", "SHKZG", "DMBTR"], 1)], "file_id string, column string, ordinal int")
    erp = M.detect_erp(cols).first()
    assert erp.erp == "SAP"
    syn, fields = C.synonyms(spark), C.field_definitions(spark)
    plain = {r.field_type: r.exact_conf for r in M.exact_matches(cols, syn, fields).collect()}
    own = {r.field_type: r.exact_conf for r in M.exact_matches(cols.withColumn("erp", F.lit("SAP")), syn, fields, "erp").collect()}
    assert own["journal_entry_id"] == pytest.approx(0.95 + 0.05 * 0.95) and plain["journal_entry_id"] == pytest.approx(0.85 + 0.1 * 0.95)


def test_ties_go_to_the_mapper_then_validator_order(spark):
    rows = [("f", "c", "vendor_id", 0.9, "mapper", None), ("f", "c", "amount", 0.9, "content_validator", 0.9), ("f", "c", "journal_entry_id", 0.9, "content_validator", 0.9)]
    cands = spark.createDataFrame(rows, "file_id string, column string, field_type string, confidence double, source string, validator_score double")
    assert [r.field_type for r in M.top_candidates(cands).orderBy("rank").collect()] == ["vendor_id", "journal_entry_id", "amount"]


def test_review_queue_has_every_column(spark):
    cols = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("f", "c", 3)], "file_id string, column string, ordinal int")
    maps = spark.createDataFrame([("f", "a", "amount", 0.9, "no_conflict"), ("f", "b", "vendor_id", 0.76, "no_conflict")],
                                 "file_id string, column string, field_type string, confidence double, resolution_type string")
    alts = spark.createDataFrame([("f", "c", 1, "amount", 0.7, "amount pattern: 1")], "file_id string, column string, rank int, field_type string, confidence double, reason string")
    q = R.review_queue(cols, maps, alts)
    assert {r.column: r.band for r in q.collect()} == {"a": "high", "b": "low", "c": "none"}
    decided = spark.createDataFrame([("f", "c", "alternative", "amount"), ("f", "a", "reject", None)], "file_id string, column string, choice string, chosen_field string")
    got = {r.column: (r.field_type, r.confidence, r.decision_type) for r in R.apply_decisions(q, decided).collect()}
    assert got == {"b": ("vendor_id", 0.76, "automatic"), "c": ("amount", 0.7, "user_correction")}


def test_same_ids_in_two_ledgers(spark):
    rows = [("f1", "1", 10.0, "x", 1), ("f2", "1", -10.0, "y", 2), ("f2", "1", 10.0, None, 3), ("f2", None, 4.0, "z", 4)]
    df = spark.createDataFrame(rows, "file_id string, journal_entry_id string, amount double, description string, row_id int")
    got = {(r.file_id, r.journal_entry_id): r.is_balanced for r in B.entry_balance(df, group_cols=["file_id"]).collect()}
    assert got == {("f1", "1"): False, ("f2", "1"): True}
    rep = {r.file_id: (r.total_amount_sum, r.entries_count, r.balanced_entries_count) for r in B.balance_report(df, group_cols=["file_id"]).collect()}
    assert rep == {"f1": (10.0, 1, 0), "f2": (4.0, 1, 1)}
    assert {r.file_id: r.is_balanced for r in B.total_balance(df, group_cols=["file_id"]).collect()} == {"f1": False, "f2": False}
    assert B.entry_quality(B.entry_balance(df, group_cols=["file_id"]), ["file_id"]).count() == 2
    head = J.journal_header(df, group_cols=["file_id"])
    assert {(r.file_id, r.journal_entry_id, r.description) for r in head.collect()} == {("f1", "1", "x"), ("f2", "1", "y"), ("f2", None, "z")}
    first = J.header_first_nonnull(df.select("file_id", "journal_entry_id", "description", "row_id"), group_cols=["file_id"])
    assert {(r.file_id, r.description) for r in first.collect()} == {("f1", "x"), ("f2", "y")}
    assert {(r.file_id, r.description) for r in J.keyless_header(df, group_cols=["file_id"]).collect()} == {("f1", "x"), ("f2", "y")}


def test_checkpoint_folder_must_be_given_on_a_cluster(monkeypatch):
    from cuadre import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = getCheckpointDir = staticmethod(lambda: None)

    Context.getConf = staticmethod(lambda: Conf())
    fake = type("S", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)
