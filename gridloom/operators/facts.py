"""Compiled facts with text numbers, and ordered keyword rules for their categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import power
from gridloom.operators.rollups import NUMBER, NUMBER_RANGE

# The words that decide a category, in the order in which the rules are tried.
IDLE_WORDS = [("phase", "idle"), ("workload", "idle")]
TRAINING_WORDS = [("workload", "training"), ("phase", "training")]
#: (category, words of which one must be there, words of which one must be there too); None: no category.
RULES: list[tuple[str | None, list[tuple[str, str]], list[tuple[str, str]]]] = [
    (None, [("phase", x) for x in ("facility", "cluster", "server", "fit", "energy", "management", "cold_start", "ratio", "floor", "cpu")] + [("workload", "host")], []),
    ("idle: bare", IDLE_WORDS, [("phase", "bare"), ("phase", "deep"), ("phase", "node_idle"), ("workload", "idle_fleet")]),
    ("idle: allocated", IDLE_WORDS, []),
    ("stress / compute phase", [("workload", "stress"), ("phase", "burn"), ("phase", "hpl"), ("phase", "compute_phase")], []),
    ("training: comm trough", TRAINING_WORDS, [("phase", "trough"), ("phase", "comm")]),
    ("training: mean", TRAINING_WORDS, []),
    ("inference: prefill", [("phase", "prefill")], []),
    ("inference: decode-dominated", [("phase", "decode")], []),
    ("inference: diffusion", [("phase", "diffusion"), ("workload", "diffusion")], []),
    ("inference: offline batch", [("phase", "offline"), ("workload", "offline")], []),
    ("inference: online mixed", [("phase", "online"), ("workload", "inference"), ("phase", "serving")], []),
]


def category_sql() -> str:
    any_of = lambda words: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for c, w in words) + ")"
    rules = " ".join(f"WHEN {any_of(a)}{' AND ' + any_of(b) if b else ''} THEN " + (f"'{name}'" if name else "NULL") for name, a, b in RULES)
    return f"CASE {rules} END"


def category() -> Column:
    return F.expr(category_sql()).alias("category")


def saturated(top: float) -> float:
    """Power over rated power where a curve ends at top."""
    return power.IDLE + (1 - power.IDLE) * top


MODELLED = {
    "idle: allocated": power.IDLE, "training: mean": saturated(power.CURVES["training"][-1]), "stress / compute phase": saturated(1.0),
    "inference: online mixed": saturated(power.CURVES["online_inference"][-1]), "inference: decode-dominated": saturated(power.CURVES["online_inference"][-1]), "inference: offline batch": saturated(power.CURVES["offline_inference"][-1]),
}
#: The same parsing as rollups.number_of, as common table expressions over x(s).
PARSED = f"y AS (SELECT *, regexp_extract(trim(s), '{NUMBER_RANGE}', 1) AS a, regexp_extract(trim(s), '{NUMBER_RANGE}', 2) AS b, regexp_extract(trim(s), '{NUMBER}', 1) AS c FROM x), z AS (SELECT *, CASE WHEN a <> '' THEN (TRY_CAST(a AS DOUBLE) + TRY_CAST(b AS DOUBLE)) / 2 ELSE TRY_CAST(c AS DOUBLE) END AS number FROM y)"
