"""Multi-step Column formulas without expression blow-up.

A cleaner such as N01 refers to its intermediate values (the filtered text, the separator positions, ...) many times.
Built as one nested Column, every reference copies the whole sub-tree, which bloats analysis and overflows Java's
64 KB method limit in whole-stage codegen (Spark then falls back to slow interpreted evaluation).

A ``Formula`` is a list of stages, each a dict ``name -> builder(get)``. It can be used two ways:

* ``inline(formula, col)`` returns one Column (fine for a few rows or a single use);
* ``apply(df, formula, {out: src})`` adds each stage as a projection of temporary columns, so every intermediate is
  computed once per row. Catalyst does not collapse projections that would duplicate non-trivial expressions, so the
  plan keeps one small Project per stage, all inside the same whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Getter = Callable[[str], Column]
Stage = dict[str, Callable[[Getter], Column]]
Formula = list[Stage]


def inline(formula: Formula, value: Column, **params: Column) -> Column:
    env: dict[str, Column] = {"v": value, **params}
    for stage in formula:
        for name, build in stage.items():
            env[name] = build(env.__getitem__)
    return env["out"]


def apply(df: DataFrame, formula: Formula, outputs: dict[str, Column | str], **params: Column | str) -> DataFrame:
    """Add ``out`` of ``formula`` for each ``{output_name: source}``; intermediates are dropped at the end."""
    temps: list[str] = []
    per_out: list[tuple[str, str]] = []
    first: dict[str, Column] = {}
    for i, (out, src) in enumerate(outputs.items()):
        prefix = f"__st{i}_"
        per_out.append((out, prefix))
        first[prefix + "v"] = F.col(src) if isinstance(src, str) else src
        for k, p in params.items():
            first[prefix + k] = F.col(p) if isinstance(p, str) else p
    df = df.withColumns(first)
    temps += list(first)
    for stage in formula:
        cols = {}
        for out, prefix in per_out:
            get = (lambda pre: (lambda name: F.col(pre + name)))(prefix)
            for name, build in stage.items():
                cols[prefix + name] = build(get)
        df = df.withColumns(cols)
        temps += [c for c in cols if c not in temps]
    final = {out: F.col(prefix + "out") for out, prefix in per_out}
    df = df.withColumns(final)
    return df.drop(*[t for t in temps if t not in final])
