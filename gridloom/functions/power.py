"""The row power model: idle and active power of devices from sufficient statistics of utilisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
TDP = {"A10": 150.0, "A30": 165.0, "A100": 400.0, "A800": 400.0, "H800": 700.0, "H20": 400.0, "H20-141GB": 400.0, "L20": 275.0}
TDP_XPU, TDP_DEFAULT = 475.0, 400.0
KNOTS = [0.0, 0.25, 0.5, 0.75, 1.0]
CURVES = {
    "training": [0.0, 0.50, 0.75, 0.90, 1.00],
    "online_inference": [0.0, 0.20, 0.35, 0.45, 0.55],
    "offline_inference": [0.0, 0.30, 0.50, 0.70, 0.85],
}
LINEAR = [0.0, 0.25, 0.5, 0.75, 1.0]
IDLE, NULL_LEVEL, ONLINE_FLOOR, PUE = 0.20, 0.3, 0.43, 1.2
HOST_IDLE, HOST_PEAK = 1.5, 4.0
TDP_RANGES = {"A100": (300.0, 460.0), "A800": (300.0, 460.0)}
TDP_SPREAD, XPU_RANGE = 0.15, (250.0, 700.0)
PARAMETERS = {
    "phi": ((0.15, 0.25), 0.20), "null_level": ((0.1, 0.5), 0.3), "pue": ((1.1, 1.4), 1.2), "online_floor": ((0.35, 0.50), 0.43),
    "host_idle": ((1.0, 2.0), 1.5), "host_peak": ((3.0, 6.0), 4.0), "family": ((0.0, 1.0), 0.0),
}
ELIGIBILITY = ("conservative", "central", "liberal")
BOUNDARIES = ("attributed", "idle_retained", "node_sleep")


def configured(config: dict) -> dict:
    """The parameters of a configuration: base values of the model where it has none of its own. A value may be a number
    or have a base and a range."""
    base = lambda x: x["base"] if isinstance(x, dict) else x
    names = {"phi": "idle_frac", "null_level": "null_util_g", "pue": "pue", "online_floor": "online_floor_frac"}
    out = {n: float(base(config.get(key, default))) for (n, key), (_, default) in zip(names.items(), (PARAMETERS[n] for n in names), strict=True)}
    return out | {"tdp": {k: float(base(v)) for k, v in config.get("gpu_tdp_w", {}).items()}}


def hinges(values: list[float], knots: list[float] = KNOTS) -> list[float]:
    """Coefficients of max(u - knot, 0) that make up the piecewise-linear curve through the values."""
    slope = [(b - a) / (y - x) for a, b, x, y in zip(values, values[1:], knots, knots[1:], strict=False)]
    return [slope[0], *[b - a for a, b in zip(slope, slope[1:], strict=False)]]


def tdp(spec: str = "spec") -> Column:
    c = F.when(F.col(spec).startswith("XPU"), F.lit(TDP_XPU))
    for name, watts in TDP.items():
        c = c.when(F.col(spec) == name, F.lit(watts))
    return c.otherwise(F.lit(TDP_DEFAULT))


def utilised(job: str = "job_type") -> Column:
    """The curve of each kind of job, applied to weights above the knots s0, s25, s50, s75."""
    def on(values: list[float]) -> Column:
        return sum((F.lit(c) * F.col(s) for c, s in zip(hinges(values), ["s0", "s25", "s50", "s75"], strict=True)), F.lit(0.0))

    c = None
    for name, values in CURVES.items():
        c = F.when(F.col(job) == name, on(values)) if c is None else c.when(F.col(job) == name, on(values))
    return c.otherwise(on(LINEAR))


def online_offset(idle: float = IDLE, floor: float = ONLINE_FLOOR) -> float:
    return max(0.0, (floor - idle) / (1 - idle))


def energy(phi: Column | float = IDLE, null_level: Column | float = NULL_LEVEL) -> tuple[Column, Column]:
    """(idle, active) energy of a row of statistics; online work has a floor, standby is not active."""
    phi, null_level = (x if isinstance(x, Column) else F.lit(x) for x in (phi, null_level))
    level = utilised() + null_level * F.col("gpu_hours_null_util")
    c0 = F.greatest(F.lit(0.0), (F.lit(ONLINE_FLOOR) - phi) / (1 - phi))
    online = c0 * F.col("gpu_hours") + (1 - c0 / F.lit(CURVES["online_inference"][-1])) * level
    level = F.when(F.col("state") == "Standby", F.lit(0.0)).when(F.col("job_type") == "online_inference", online).otherwise(level)
    return tdp() * phi * F.col("gpu_hours"), tdp() * (1 - phi) * level


#: Who may be curtailed, as conditions on a row.
CURTAILED = {
    "conservative": "priority_class = 'LP' AND job_type IN ('training', 'offline_inference')",
    "central": "priority_class = 'LP'",
    "liberal": "priority_class = 'LP' OR (priority_class = 'HP' AND job_type = 'offline_inference')",
}


def layer_sql(eligibility: str = "central") -> str:
    return f"CASE WHEN state = 'Standby' THEN 'standby' WHEN {CURTAILED[eligibility]} THEN 'curtail' WHEN priority_class = 'HP' AND job_type IN ('training', 'offline_inference') THEN 'shift' ELSE 'floor' END"


def layer(eligibility: str = "central") -> Column:
    """The layer of flexibility of a row; the first that fits."""
    return F.expr(layer_sql(eligibility))


def curtailed(boundary: str) -> Column:
    """What curtailing frees: all of a row's energy, or its active part if idle power stays."""
    return F.col("active") if boundary == "idle_retained" else F.col("idle") + F.col("active")


# The same as SQL text, for the comparison queries.
TDP_SQL = "CASE WHEN spec LIKE 'XPU%' THEN 475.0 " + " ".join(f"WHEN spec = '{k}' THEN {v}" for k, v in TDP.items()) + " ELSE 400.0 END"


def on_sql(values: list[float]) -> str:
    return "(" + " + ".join(f"cast({c!r} AS DOUBLE) * {s}" for c, s in zip(hinges(values), ["s0", "s25", "s50", "s75"], strict=True)) + ")"


UTILISED_SQL = "CASE " + " ".join(f"WHEN job_type = '{k}' THEN {on_sql(v)}" for k, v in CURVES.items()) + f" ELSE {on_sql(LINEAR)} END"


def active_sql(phi: str = str(IDLE), null_level: str = str(NULL_LEVEL)) -> str:
    level = f"({UTILISED_SQL} + {null_level} * gpu_hours_null_util)"
    c0 = f"greatest(0, ({ONLINE_FLOOR} - {phi}) / (1 - {phi}))"
    return f"{TDP_SQL} * (1 - {phi}) * CASE WHEN state = 'Standby' THEN 0 WHEN job_type = 'online_inference' THEN {c0} * gpu_hours + (1 - {c0} / 0.55) * {level} ELSE {level} END"


LAYER_SQL = layer_sql()


def curve_sql(u: str, values: list[float]) -> str:
    return "(" + " + ".join(f"{c!r}::DOUBLE * greatest({u} - {k}, 0)" for c, k in zip(hinges(values), KNOTS, strict=False)) + ")"
