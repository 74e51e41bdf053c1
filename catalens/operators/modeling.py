"""Proportional-hazards and discrete-time hazard models fitted with Spark aggregates.

A Cox iteration is one aggregation of the rows by time and one running total over the times, a hazard iteration
one aggregation of the person-period rows; only the gradient and the p × p curvature, one row, come to the driver
for the Newton step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..plans.ordered import SMALL_ROWS, running
from .features import person_period
from .survival import Z95

_TIED_EVENTS_PER_ROW = 1000


@dataclass
class CoxModel:
    features: list[str]
    means: list[float]
    coefficients: list[float]
    standard_errors: list[float]
    log_likelihood: float
    iterations: int
    baseline: DataFrame  # time, events, hazard, cumulative_hazard, survival

    def log_partial_hazard(self) -> Column:
        return sum(
            ((F.col(f) - m) * b for f, m, b in zip(self.features, self.means, self.coefficients)), F.lit(0.0)
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f, float(b), float(np.exp(b)), float(s), float(np.exp(b - Z95 * s)), float(np.exp(b + Z95 * s)))
            for f, b, s in zip(self.features, self.coefficients, self.standard_errors)
        ]
        spec = "feature string, coef double, hazard_ratio double, se double, hr_lower double, hr_upper double"
        return spark.createDataFrame(rows, spec)


def _linear(names: list[str], beta: np.ndarray) -> Column:
    return sum((F.col(n) * float(b) for n, b in zip(names, beta)), F.lit(0.0))


@dataclass
class _Design:
    """Standardised rows (t, e, x0 …), written once and read in every iteration."""

    rows: DataFrame
    columns: list[str]
    means: list[float]
    scales: list[float]
    n: int
    most_tied: int
    small: bool


def _design(df: DataFrame, duration: str, event: str, features: list[str], *, standardise: bool = True) -> _Design:
    known = df.dropna(subset=[duration, event, *features])
    stats = known.agg(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev(f).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    p = range(len(features))
    means = [stats[f"m{i}"] if standardise else 0.0 for i in p]
    scales = [(stats[f"s{i}"] or 1.0) if standardise else 1.0 for i in p]
    columns = [f"x{i}" for i in p]
    rows = materialize(
        known.select(
            F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
            *[((F.col(f) - m) / s).alias(x) for f, m, s, x in zip(features, means, scales, columns)],
        ),
        "design",
    )
    shape = rows.groupBy("t").agg(F.sum("e").alias("d")).agg(F.count("*").alias("times"), F.max("d").alias("d")).first()
    return _Design(rows, columns, means, scales, stats["n"], shape["d"] or 0, shape["times"] <= SMALL_ROWS)


def _partial_likelihood(design: _Design, beta: np.ndarray, ties: str) -> DataFrame:
    """One row: log partial likelihood ``ll``, gradient ``g0 …`` and curvature ``h0_0 …`` at ``beta``."""
    xs = design.columns
    pairs = list(combinations_with_replacement(range(len(xs)), 2))
    score = _linear(xs, beta)
    rows = design.rows.withColumn("w", F.exp(score)).withColumn("ew", F.col("w") * F.col("e"))

    def moments(weight: str, prefix: str) -> dict[str, Column]:
        w = F.col(weight)
        return {
            f"{prefix}0": F.sum(w),
            **{f"{prefix}1_{i}": F.sum(w * F.col(x)) for i, x in enumerate(xs)},
            **{f"{prefix}2_{i}_{j}": F.sum(w * F.col(xs[i]) * F.col(xs[j])) for i, j in pairs},
        }

    everyone, dead = moments("w", "s"), moments("ew", "d")
    own = {f"ex_{i}": F.sum(F.col("e") * F.col(x)) for i, x in enumerate(xs)}
    per_time = rows.groupBy("t").agg(
        F.sum("e").alias("d"), F.sum(F.col("e") * score).alias("es"),
        *[c.alias(k) for k, c in {**everyone, **dead, **own}.items()],
    )
    at_risk = running(
        per_time, [F.col("t").desc()], sums={f"r{k[1:]}": F.col(k) for k in everyone}, small=design.small
    ).where("d > 0")
    if ties == "efron":
        # the i-th of d tied events sees i/d of their weight removed; long runs of ties are split
        size = F.lit(_TIED_EVENTS_PER_ROW).cast("long")
        at_risk = at_risk.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1, size)))
        if design.most_tied > 100 * _TIED_EVENTS_PER_ROW:
            at_risk = at_risk.repartition("t", "from")
        upto = F.least(F.col("from") + size, F.col("d")) - 1
        at_risk = at_risk.withColumn("k", F.explode(F.sequence("from", upto)))
        share, weight, first = F.col("k") / F.col("d"), F.lit(1), F.col("k") == 0
    else:
        share, weight, first = F.lit(0.0), F.col("d"), F.lit(True)

    def left(suffix: str) -> Column:
        return F.col(f"r{suffix}") - share * F.col(f"d{suffix}")

    def once(name: str) -> Column:
        return F.when(first, F.col(name)).otherwise(0.0)

    s0 = left("0")
    return at_risk.agg(
        F.sum(once("es") - weight * F.log(s0)).alias("ll"),
        *[F.sum(once(f"ex_{i}") - weight * left(f"1_{i}") / s0).alias(f"g{i}") for i in range(len(xs))],
        *[
            F.sum(weight * (left(f"2_{i}_{j}") / s0 - left(f"1_{i}") * left(f"1_{j}") / s0 / s0)).alias(f"h{i}_{j}")
            for i, j in pairs
        ],
    )


def _newton(
    step: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], p: int, n: int, max_iterations: int,
    tolerance: float,
) -> tuple[np.ndarray, float, np.ndarray, int]:
    """Newton's method from zero; a move that lowers the value is halved. Coefficients, value, curvature, iterations.

    A feature that never varies leaves the curvature singular; the shortest move keeps its coefficient at 0.
    """
    beta = np.zeros(p)
    value, gradient, curvature = step(beta)
    iterations = 0
    for iterations in range(1, max_iterations + 1):
        move, size = np.linalg.lstsq(curvature, gradient, rcond=None)[0], 1.0
        tried = step(beta + move)
        while tried[0] < value - 1e-12 * abs(value) and size > 1e-4:
            size /= 2
            tried = step(beta + size * move)
        gained = tried[0] - value
        beta = beta + size * move
        value, gradient, curvature = tried
        if abs(gained) <= tolerance * max(1.0, abs(value)) and float(np.abs(gradient).max()) < 1e-5 * n:
            break
    return beta, value, curvature, iterations


def cox_score(
    df: DataFrame, duration: str, event: str, features: Sequence[str], beta: Sequence[float], *, ties: str = "efron"
) -> DataFrame:
    """Log partial likelihood, gradient and curvature of given coefficients on the features' own scale."""
    design = _design(df, duration, event, list(features), standardise=False)
    return _partial_likelihood(design, np.array(beta, dtype=float), ties)


def cox_ph(
    df: DataFrame,
    duration: str,
    event: str,
    features: Sequence[str],
    *,
    penalizer: float = 0.1,
    ties: str = "efron",
    max_iterations: int = 30,
    tolerance: float = 1e-9,
) -> CoxModel:
    """Cox model by Newton's method on standardised features with an L2 penalty.

    Maximises ``log-likelihood − n · penalizer · ‖β‖² / 2`` with β on the standardised scale; coefficients
    are returned on the original scale. Tied event times by Efron's or Breslow's approximation.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError(f"unknown ties: {ties}")
    features = list(features)
    design = _design(df, duration, event, features)
    p, pull = len(features), design.n * penalizer
    if design.most_tied == 0:
        raise ValueError("no events to fit")

    def step(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        row = _partial_likelihood(design, beta, ties).first()
        curvature = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
        gradient = np.array([row[f"g{i}"] for i in range(p)], dtype=float)
        return row["ll"] - 0.5 * pull * float(beta @ beta), gradient - pull * beta, curvature + pull * np.eye(p)

    beta, value, curvature, iterations = _newton(step, p, design.n, max_iterations, tolerance)
    errors = np.sqrt(np.diag(np.linalg.inv(curvature)))
    scales = np.array(design.scales)
    return CoxModel(
        features, design.means, [float(b) for b in beta / scales], [float(e) for e in errors / scales], value, iterations,
        _baseline(design.rows, design.columns, beta, design.small),
    )


def _baseline(design: DataFrame, xs: list[str], beta: np.ndarray, small: bool) -> DataFrame:
    """Cumulative baseline hazard (events over the weight at risk) and baseline survival per distinct time."""
    weighted = design.groupBy("t").agg(F.sum("e").alias("events"), F.sum(F.exp(_linear(xs, beta))).alias("w"))
    at_risk = running(weighted, [F.col("t").desc()], sums={"risk": "w"}, small=small)
    hazard = at_risk.select(F.col("t").alias("time"), "events", (F.col("events") / F.col("risk")).alias("hazard"))
    total = running(hazard, ["time"], sums={"cumulative_hazard": "hazard"}, small=small)
    return materialize(total.withColumn("survival", F.exp(-F.col("cumulative_hazard"))), "baseline")


def horizons(primary: int, secondary: Sequence[int]) -> list[int]:
    return sorted({primary, *secondary})


def baseline_at(baseline: DataFrame, at: Sequence[float]) -> dict[float, float]:
    """Baseline survival at the recorded time nearest to each horizon (the earlier one of two equally near)."""
    picked = baseline.agg(
        *[
            F.min_by("survival", F.struct(F.abs(F.col("time") - h), F.col("time"))).alias(f"h{i}")
            for i, h in enumerate(at)
        ]
    ).first()
    return {h: picked[f"h{i}"] for i, h in enumerate(at)}


def risk_at_horizons(
    df: DataFrame, baseline: DataFrame, log_partial_hazard: Column, at: Sequence[float], *, prefix: str = "risk_"
) -> DataFrame:
    """Adds the risk of an event by each horizon: ``1 − S0(h) ^ exp(xb)``."""
    survival = baseline_at(baseline, at)
    return df.withColumns(
        {f"{prefix}{h}": 1 - F.pow(F.lit(s), F.exp(log_partial_hazard)) for h, s in survival.items()}
    )


def _logistic_step(rows: DataFrame, xs: list[str], beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and curvature of a logistic model of ``y``; the first coefficient is the intercept."""
    terms = [F.lit(1.0), *map(F.col, xs)]
    pairs = list(combinations_with_replacement(range(len(terms)), 2))
    scored = rows.withColumn("_eta", F.lit(float(beta[0])) + _linear(xs, beta[1:]))
    scored = scored.withColumn("_p", 1 / (1 + F.exp(-F.col("_eta"))))
    eta, left, spread = F.col("_eta"), F.col("y") - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
    row = scored.agg(
        F.sum(F.col("y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))).alias("ll"),
        *[F.sum(left * x).alias(f"g{i}") for i, x in enumerate(terms)],
        *[F.sum(spread * terms[i] * terms[j]).alias(f"h{i}_{j}") for i, j in pairs],
    ).first()
    p = range(len(terms))
    curvature = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in p] for i in p], dtype=float)
    return row["ll"], np.array([row[f"g{i}"] for i in p], dtype=float), curvature


def discrete_time_hazard(
    df: DataFrame,
    duration: str,
    event: str,
    features: Sequence[str],
    *,
    width: int,
    regularization: float = 0.0,
    max_iterations: int = 30,
    tolerance: float = 1e-11,
) -> tuple[DataFrame, DataFrame]:
    """Logistic hazard per interval on person-period rows, fitted by Newton's method on standardised features.

    Maximises ``log-likelihood − n · regularization · ‖β‖² / 2`` over n person-period rows, the intercept unpenalised
    and β on the standardised scale. Rows with a feature that is null or not a number take no part in the fit; a
    feature that never varies gets 0. Returns the coefficients (``intercept``, ``interval`` and the features) and all
    person-period rows with the fitted ``hazard``.
    """
    names = ["interval", *features]
    xs = [f"x{i}" for i in range(len(names))]
    rows = materialize(
        person_period(df, duration=duration, event=event, width=width).select(
            *df.columns, "interval", "interval_event"
        ),
        "person-period",
    )
    numbers = rows.select(
        F.col("interval_event").cast("double").alias("y"), *[F.col(c).cast("double").alias(x) for c, x in zip(names, xs)]
    )
    known = numbers.dropna()
    stats = known.agg(
        F.count("*").alias("n"), F.sum("y").alias("events"), *[F.avg(x).alias(f"m_{x}") for x in xs],
        *[F.stddev(x).alias(f"s_{x}") for x in xs],
    ).first()
    if not stats["events"] or stats["events"] == stats["n"]:
        raise ValueError("no events to fit" if not stats["events"] else "an event in every interval")
    means = np.array([stats[f"m_{x}"] for x in xs])
    scales = np.array([stats[f"s_{x}"] or 1.0 for x in xs])
    design = known.select("y", *[((F.col(x) - float(m)) / float(s)).alias(x) for x, m, s in zip(xs, means, scales)])
    pull = stats["n"] * regularization * np.array([0.0, *[1.0] * len(xs)])

    def step(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, gradient, curvature = _logistic_step(design, xs, beta)
        return value - 0.5 * float(pull @ beta**2), gradient - pull * beta, curvature + np.diag(pull)

    beta, _, _, _ = _newton(step, len(xs) + 1, stats["n"], max_iterations, tolerance)
    slopes = beta[1:] / scales
    intercept = float(beta[0] - slopes @ means)
    spec = "feature string, coef double, odds_ratio double"
    table = [("intercept", intercept), *zip(names, map(float, slopes))]
    coefficients = df.sparkSession.createDataFrame([(f, c, float(np.exp(c))) for f, c in table], spec)
    logit = intercept + _linear(names, slopes)
    return coefficients, rows.withColumn("hazard", 1 / (1 + F.exp(-logit)))


def risk_from_hazards(periods: DataFrame, entity: str, *, upto: int) -> DataFrame:
    """Risk of an event within the first ``upto`` intervals, from fitted interval hazards."""
    inside = periods.where(F.col("interval") < upto)
    return inside.groupBy(entity).agg((1 - F.exp(F.sum(F.log1p(-F.col("hazard"))))).alias("risk"))
