"""Composite jobs and the named query catalogue. Importing this package registers every query family."""

from cuadre.plans import q_balance, q_extra, q_journal, q_lake, q_lines, q_mapping, q_misc, q_ml  # noqa: F401
from cuadre.plans.registry import OPERATORS, ORACLES, QUERIES  # noqa: F401
