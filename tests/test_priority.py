"""Priority-order harmonisation against a plain Python pass over the columns."""

import random

from pyspark.sql import functions as F

from cuadre.operators import mapping as M

NAMES = ["Saldo", "Importe", "Debe", "Haber total", "Fecha", "Fecha date", "Asiento", "journal no", "Cuenta", "Cabecera description", "header Description 2",
         "Concepto", "Descripcion", "doc 7", "Numero", "Proveedor", "Nombre cuenta", "Moneda", "xyz", "Account name"]
FIELDS = ["amount", "debit_amount", "journal_entry_id", "posting_date", "description", "gl_account_number", "vendor_id"]


def priority(name):
    low = name.lower()
    for words, p in M.PRIORITY_GROUPS:
        if any(w in low for w in words):
            return p
    return 6


def plain(columns, best, flags, trial):
    used, held, out = {}, {}, {}
    spec = lambda c, f: sum(w in c.lower() for w in M.SPECIFICITY_KEYWORDS.get(f, []))
    for c in sorted(columns, key=priority):
        low = c.lower()
        if ("cabecera" in low or "header" in low) and "description" in low and "description" not in used:
            used["description"], held[c], out[c] = c, 0.95, ("description", 0.95)
            continue
        if c not in best:
            continue
        f, conf = best[c]
        if f in used:
            old = used[f]
            if f == "journal_entry_id":
                score = lambda x, k: 0.7 * trial.get(x, k) + 0.3 * k
                wins = score(c, conf) > score(old, held[old])
            else:
                wins = conf > held[old] + 0.2 or (flags.get(c, False) if f == "amount" else spec(c, f) > spec(old, f))
            if not wins:
                continue
        used[f], held[c], out[c] = c, conf, (f, conf)
    return {c: (*v, used[v[0]] != c) for c, v in out.items()}


def test_priority_pass_matches_plain_python(spark):
    rng = random.Random(11)
    cols, best, flags, trial, want = [], [], [], [], {}
    for n in range(40):
        names = rng.sample(NAMES, rng.randrange(1, len(NAMES)))
        b = {c: (rng.choice(FIELDS), rng.choice([0.5, 0.65, 0.75, 0.9])) for c in names if rng.random() < 0.8}
        fl = {c: rng.random() < 0.4 for c in names}
        tr = {c: rng.choice([0.0, 0.3, 1.0]) for c, (f, _) in b.items() if f == "journal_entry_id" and rng.random() < 0.7}
        fid = f"f{n}"
        cols += [(fid, c, i) for i, c in enumerate(names, 1)]
        best += [(fid, c, names.index(c) + 1, f, k) for c, (f, k) in b.items()]
        flags += [(fid, c, v) for c, v in fl.items()]
        trial += [(fid, c, v) for c, v in tr.items()]
        got = plain(names, b, fl, tr)
        want |= {(fid, c): got.get(c, (None, None, None)) for c in names}
    out = M.harmonise_by_priority(spark.createDataFrame(best, "file_id string, column string, ordinal int, field_type string, confidence double"),
                                  spark.createDataFrame(cols, "file_id string, column string, ordinal int"),
                                  spark.createDataFrame(flags, "file_id string, column string, better_amount boolean"),
                                  spark.createDataFrame(trial, "file_id string, column string, quality double"))
    rows = out.collect()
    assert {(r.file_id, r["column"]): (r.field_type, r.confidence, r.taken_over) for r in rows} == want
    assert all(r.priority == priority(r["column"]) for r in rows) and any(r.taken_over for r in rows)


def test_priority_of_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "c string")
    assert [r.p for r in df.select(M.column_priority(F.col("c")).alias("p")).collect()] == [priority(n) for n in NAMES]
