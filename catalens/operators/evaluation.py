"""Evaluation of predicted risks: discrimination, calibration, lift, thresholds, drift and robustness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import global_rank, known, percentile_values, running, staged
from .survival import person_time


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


# --- discrimination ---------------------------------------------------------------------------------


def c_index(df: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """Harrell's concordance: one row with comparable, concordant and tied pairs and the index.

    A pair is comparable when one row has an event and the other lasts longer, or is censored at that same
    time; two events at one time are not compared. Equal risks count one half.

    Pairs are counted, never formed. Risks become dense ranks, and two different ranks first differ at
    exactly one binary digit: rows are grouped by the digits above it, and in each group the events with
    digit 1 are matched with the later rows with digit 0 by a running total over time. That is about
    log2(distinct risks) entries per row, pre-aggregated by time.
    """
    rows = df.where(F.col(duration).isNotNull() & F.col(risk).isNotNull())
    cells = rows.groupBy(
        F.col(duration).alias("t"), (1 - F.col(event).cast("int")).alias("censored"), F.col(risk).alias("r")
    ).agg(F.count("*").alias("n"))
    cells, small = staged(cells)
    risks = cells.select("r").distinct()
    if small:
        ranks = risks.withColumn("rank", F.row_number().over(Window.orderBy("r")) - 1)
    else:
        ranks = global_rank(risks, ["r"]).withColumn("rank", F.col("rank") - 1)
    levels = max((risks.count() - 1).bit_length(), 0)
    ranked = cells.join(ranks, "r").withColumn("rank", F.col("rank").cast("long"))
    everyone, ties = -1, -2
    n, dead = F.col("n"), F.when(F.col("censored") == 0, F.col("n")).otherwise(0)

    def entry(level: int, group: Column, first: Column, later: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), group.cast("long").alias("prefix"),
            first.cast("long").alias("first"), later.cast("long").alias("later"),
        )

    entries = [entry(everyone, F.lit(0), dead, n), entry(ties, F.col("rank"), dead, n)]
    for level in range(levels):
        digit = F.shiftright("rank", level).bitwiseAND(F.lit(1).cast("long"))
        entries.append(
            entry(
                level, F.shiftright("rank", level + 1),
                F.when(digit == 1, dead).otherwise(0), F.when(digit == 0, n).otherwise(0),
            )
        )
    keys = ["level", "prefix"]
    grouped = (
        ranked.select("t", "censored", F.inline(F.array(*entries)))
        .where("first > 0 or later > 0")
        .groupBy(*keys, "t", "censored")
        .agg(F.sum("first").alias("first"), F.sum("later").alias("later"))
    )
    if small:
        # partitions of at most as many rows as the checked table has distinct times
        grouped = running(
            grouped, [F.col("t").desc(), F.col("censored").desc()], partition=keys, sums={"after": "later"},
            prior=True, small=True,
        )
    else:
        grouped = running(
            grouped, [F.col("t").desc(), F.col("censored").desc()], partition=keys, sums={"after": "later"}, prior=True
        )
    pairs = F.col("first").cast("double") * F.col("after")
    level = F.col("level")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, pairs)), F.lit(0.0))

    return grouped.agg(
        total(level == everyone).alias("comparable"),
        total(level >= 0).alias("concordant"),
        total(level == ties).alias("tied"),
    ).withColumn("c_index", _share(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable")))


def horizon_label(duration: str, event: str, horizon: float) -> Column:
    """1 for an event by the horizon, 0 for a row known to last longer, null for one censored before it."""
    happened = (F.col(event) == 1) & (F.col(duration) <= horizon)
    return F.when(happened, 1).when(F.col(duration) >= horizon, 0)


def auc(df: DataFrame, label: str, score: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores count one half. Rows without a label are left out."""
    by = list(by)
    per_score, small = staged(
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("s"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    ordered = running(per_score, ["s"], partition=by, sums={"below": "neg"}, prior=True, small=small)
    wins = F.col("pos").cast("double") * (F.col("below") + 0.5 * F.col("neg"))
    return ordered.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(wins).alias("_wins")
    ).select(
        *by, "positives", "negatives",
        _share(F.col("_wins"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"),
    )


def auc_at_horizon(df: DataFrame, duration: str, event: str, risk: str, horizon: float) -> DataFrame:
    labelled = df.withColumn("_label", horizon_label(duration, event, horizon))
    return auc(labelled, "_label", risk).withColumn("horizon", F.lit(horizon))


# --- calibration ------------------------------------------------------------------------------------


def bin_by_cuts(value: Column, cuts: Sequence[float]) -> Column:
    """1-based bin: left-closed, as many bins as cuts plus one."""
    return sum((F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(1))


def calibration_bins(df: DataFrame, risk: str, event: str, *, bins: int = 10) -> DataFrame:
    """Rows, mean predicted and observed rate per bin between the risk percentiles; empty bins are left out.

    Rows whose risk is null or not a number are in no bin.
    """
    df = known(df, risk)
    cuts = percentile_values(df, risk, [i / bins for i in range(1, bins)])
    return df.groupBy(bin_by_cuts(F.col(risk), cuts).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(risk).alias("mean_predicted"), F.avg(event).alias("observed_rate")
    )


def calibration_slope(bins: DataFrame) -> DataFrame:
    """Slope and intercept of the observed on the predicted bin rates."""
    return bins.agg(
        F.regr_slope("observed_rate", "mean_predicted").alias("slope"),
        F.regr_intercept("observed_rate", "mean_predicted").alias("intercept"),
    )


def brier_scores(df: DataFrame, duration: str, event: str, risks: dict[float, str | Column]) -> DataFrame:
    """Mean squared error per horizon over the rows whose state at the horizon is known; one pass."""
    entries = []
    for horizon, risk in sorted(risks.items()):
        label = horizon_label(duration, event, horizon)
        predicted = F.col(risk) if isinstance(risk, str) else risk
        entries.append(
            F.struct(
                F.lit(float(horizon)).alias("horizon"), F.count(label).alias("n"),
                F.avg(F.pow(predicted - label, F.lit(2))).alias("brier"),
            )
        )
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def integrated_brier(scores: DataFrame) -> DataFrame:
    """Trapezoid over the horizons divided by their range (one row per horizon comes in)."""
    w = Window.orderBy("horizon")
    strips = scores.withColumn(
        "_area",
        (F.col("horizon") - F.lag("horizon").over(w)) * (F.col("brier") + F.lag("brier").over(w)) / 2,
    )
    return strips.agg((F.sum("_area") / (F.max("horizon") - F.min("horizon"))).alias("integrated_brier"))


# --- lift, tiers, capacity --------------------------------------------------------------------------


def with_deciles(df: DataFrame, risk: str, key: str, *, groups: int = 10, total: int | None = None) -> DataFrame:
    """Adds ``rank`` and ``decile`` by falling risk; groups of n div k rows, the last takes the remainder."""
    ranked = global_rank(df, [F.col(risk).desc(), F.col(key)])
    size = (total if total is not None else ranked.count()) // groups
    if size == 0:  # fewer rows than groups: all of them are the remainder
        return ranked.withColumn("decile", F.lit(groups))
    decile = F.least(F.lit(groups), F.floor((F.col("rank") - 1) / size) + 1)
    return ranked.withColumn("decile", decile.cast("int"))


def lift_table(df: DataFrame, risk: str, event: str, key: str, *, groups: int = 10) -> DataFrame:
    """Per risk group: rows, events, event rate, cumulative share of events and lift.

    Rows whose risk is null or not a number are in no group.
    """
    per_group = with_deciles(known(df.select(key, risk, event), risk), risk, key, groups=groups).groupBy("decile").agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events")
    )
    upto = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # one row per group
    everything = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = per_group.withColumns(
        {
            "_upto": F.sum("events").over(upto),
            "_events": F.sum("events").over(everything),
            "_n": F.sum("n").over(everything),
        }
    )
    rate = F.col("events") / F.col("n")
    return out.select(
        "decile", "n", "events", rate.alias("event_rate"),
        _share(F.col("_upto"), F.col("_events")).alias("cumulative_capture"),
        F.when(F.col("_events") != 0, rate / (F.col("_events") / F.col("_n"))).alias("lift"),
    )


def risk_tiers(df: DataFrame, risk: str, event: str, key: str) -> DataFrame:
    """High (decile 1), medium (2–7) and low (8–10) risk: rows, events and event rate.

    Rows whose risk is null or not a number are in no tier.
    """
    tier = F.when(F.col("decile") == 1, "high").when(F.col("decile") <= 7, "medium").otherwise("low")
    return with_deciles(known(df.select(key, risk, event), risk), risk, key).groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"),
        F.avg(event).alias("event_rate"),
    )


def threshold_tiers(df: DataFrame, risk: str, event: str, *, high: float = 0.3, low: float = 0.15) -> DataFrame:
    """Tiers by risk thresholds: above ``high``, between, below ``low``.

    Rows whose risk is null or not a number are in no tier.
    """
    df = known(df, risk)
    tier = F.when(F.col(risk) > high, "high").when(F.col(risk) >= low, "medium").otherwise("low")
    return df.groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"), F.avg(event).alias("event_rate")
    )


def capacity_coverage(df: DataFrame, risk: str, event: str, key: str, capacities: Sequence[int]) -> DataFrame:
    """Share of events and of rows reached by treating the ``capacity`` riskiest rows.

    Rows whose risk is null or not a number are not counted.
    """
    steps = sorted(capacities)
    ranked = global_rank(known(df.select(key, risk, event), risk), [F.col(risk).desc(), F.col(key)])
    step = sum((F.when(F.col("rank") > c, 1).otherwise(0) for c in steps), F.lit(0))
    per_step = ranked.groupBy(step.alias("step")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events")
    )
    # as many rows as capacities plus one
    reached = per_step.agg(
        F.sum("n").alias("_n"), F.sum("events").alias("_events"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("capacity"),
                    F.coalesce(F.sum(F.when(F.col("step") <= i, F.col("n"))), F.lit(0)).alias("treated"),
                    F.coalesce(F.sum(F.when(F.col("step") <= i, F.col("events"))), F.lit(0)).alias("events"),
                )
                for i, c in enumerate(steps)
            ]
        ).alias("e"),
    )
    return reached.select("_n", "_events", F.inline("e")).select(
        "capacity", "treated", "events",
        (100.0 * _share(F.col("events"), F.col("_events"))).alias("events_pct"),
        (100.0 * _share(F.col("treated"), F.col("_n"))).alias("population_pct"),
    )


def decision_curve(df: DataFrame, risk: str, event: str, thresholds: Sequence[float]) -> DataFrame:
    """Net benefit of treating rows at or above each threshold, and of treating everyone.

    Rows are counted once per threshold interval; the thresholds then add up a handful of rows. Rows whose risk is
    null or not a number are not counted.
    """
    df = known(df, risk)
    cuts = sorted(thresholds)
    step = sum((F.when(F.col(risk) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    per_step = df.groupBy(step.alias("step")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events")
    )
    out = per_step.agg(
        F.sum("n").alias("_n"), F.sum("events").alias("_events"),
        F.array(
            *[
                F.struct(
                    F.lit(float(c)).alias("threshold"),
                    F.coalesce(F.sum(F.when(F.col("step") > i, F.col("events"))), F.lit(0)).alias("true_positives"),
                    F.coalesce(F.sum(F.when(F.col("step") > i, F.col("n") - F.col("events"))), F.lit(0)).alias(
                        "false_positives"
                    ),
                )
                for i, c in enumerate(cuts)
            ]
        ).alias("e"),
    )
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return out.select("_n", "_events", F.inline("e")).select(
        "threshold", "true_positives", "false_positives",
        (F.col("true_positives") / F.col("_n") - F.col("false_positives") / F.col("_n") * odds).alias("net_benefit"),
        (F.col("_events") / F.col("_n") - (F.col("_n") - F.col("_events")) / F.col("_n") * odds).alias("treat_all"),
    )


# --- groups, windows, grids -------------------------------------------------------------------------


def subgroup_parity(df: DataFrame, segment: str, risk: str, event: str, *, threshold: float) -> DataFrame:
    """Per segment: rows, events, mean risk, false positive and false negative rate at a threshold."""
    flagged, hit = F.col(risk) >= threshold, F.col(event) == 1
    return df.groupBy(segment).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("events"), F.avg(risk).alias("mean_risk"),
        _share(F.count_if(flagged & ~hit), F.count_if(~hit)).alias("fpr"),
        _share(F.count_if(~flagged & hit), F.count_if(hit)).alias("fnr"),
    )


def parity_gaps(parity: DataFrame) -> DataFrame:
    """Largest difference between segments of each rate."""
    def gap(name: str) -> Column:
        return (F.max(name) - F.min(name)).alias(f"{name}_gap")

    rate = parity.withColumn("event_rate", F.col("events") / F.col("n"))
    return rate.agg(gap("event_rate"), gap("mean_risk"), gap("fpr"), gap("fnr"))


def in_windows(df: DataFrame, time: str, *, start: str, length_days: int, step_days: int, windows: int) -> DataFrame:
    """One row per row and rolling window that contains it; the window numbers are computed, not joined."""
    day = F.datediff(F.col(time), F.lit(start).cast("date"))
    first = F.greatest(F.lit(0), F.floor((day - length_days) / step_days) + 1).cast("int")
    last = F.least(F.lit(windows - 1), F.floor(day / step_days)).cast("int")
    return df.withColumn(
        "window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    )


def backtest_windows(
    df: DataFrame, time: str, risk: str, event: str, *, start: str, length_days: int, step_days: int, windows: int
) -> DataFrame:
    """Rows, events, event rate, mean risk and AUC per rolling window."""
    rows = in_windows(df, time, start=start, length_days=length_days, step_days=step_days, windows=windows)
    plain = rows.groupBy("window").agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"),
        F.avg(event).alias("event_rate"), F.avg(risk).alias("mean_risk"),
    )
    return plain.join(auc(rows, event, risk, by=["window"]).select("window", "auc"), "window", "left")


def sensitivity_grid(
    df: DataFrame, *, first: str, last: str, tenures: Sequence[int], cutoffs: Sequence[str]
) -> DataFrame:
    """Cohort size, events and event rate for every minimum tenure and cut-off date."""
    kind = df.schema[last].dataType
    grid = F.array(
        *[
            F.struct(F.lit(t).alias("min_tenure"), F.lit(c).alias("cutoff"))
            for t in tenures
            for c in cutoffs
        ]
    )
    rows = (
        df.withColumn("duration", F.datediff(last, first).cast("long"))
        .select("*", F.inline(grid))
        .where(F.col("duration") > F.col("min_tenure"))
        .withColumn("event", (F.col(last) < F.col("cutoff").cast(kind)).cast("int"))
    )
    return person_time(rows, "duration", "event", by=["min_tenure", "cutoff"])


# --- uncertainty ------------------------------------------------------------------------------------


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) draw from a uniform number in [0, 1)."""
    chance, upto, chain = 0.36787944117144233, 0.0, None
    for k in range(18):
        chance = chance if k == 0 else chance / k
        upto += chance
        chain = F.when(uniform < upto, k) if chain is None else chain.when(uniform < upto, k)
    return chain.otherwise(18)


def hashed_uniform(*key: str) -> Column:
    """Repeatable uniform number in [0, 1) from the key columns."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / F.lit(float(1 << 53))


def bootstrap_rates(
    df: DataFrame, value: str, key: str, *, replicates: int = 200, uniform: Column | None = None
) -> DataFrame:
    """Weighted mean of ``value`` per bootstrap replicate.

    Each row gets a repeatable Poisson weight per replicate, so the replicates need no resampling shuffle;
    they are summed in the map tasks and one row per replicate travels.
    """
    draws = df.select(key, value).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weight = poisson_weight(uniform if uniform is not None else hashed_uniform(key, "replicate"))
    return draws.groupBy("replicate").agg(
        _share(F.sum(weight * F.col(value)).cast("double"), F.sum(weight)).alias("rate")
    )


def bootstrap_ci(
    df: DataFrame, value: str, key: str, *, replicates: int = 200, level: float = 0.95, uniform: Column | None = None
) -> DataFrame:
    """Point estimate and percentile interval of a mean (one row per replicate is ordered)."""
    rates = bootstrap_rates(df, value, key, replicates=replicates, uniform=uniform)
    tail = (1 - level) / 2
    point = df.agg(F.avg(value).alias("rate")).select(F.lit(0).alias("replicate"), "rate")
    drawn = F.when(F.col("replicate") > 0, F.col("rate"))
    return rates.unionByName(point).agg(
        F.max(F.when(F.col("replicate") == 0, F.col("rate"))).alias("estimate"),
        F.percentile(drawn, tail).alias("ci_lower"), F.percentile(drawn, 1 - tail).alias("ci_upper"),
    )


# --- drift ------------------------------------------------------------------------------------------


def psi_drift(baseline: DataFrame, current: DataFrame, column: str, *, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability per bin between the baseline's percentiles; add ``psi`` up for the index."""
    cuts = percentile_values(baseline, column, [i / bins for i in range(1, bins)])

    def shares(df: DataFrame, name: str) -> DataFrame:
        known = df.where(F.col(column).isNotNull())
        counts = known.groupBy(bin_by_cuts(F.col(column), cuts).alias("bin")).agg(F.count("*").alias("n"))
        total = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return counts.select("bin", (F.col("n") / total).alias(name))

    both = shares(baseline, "expected").join(shares(current, "actual"), "bin", "full")
    e = F.greatest(F.coalesce("expected", F.lit(0.0)), F.lit(floor))
    a = F.greatest(F.coalesce("actual", F.lit(0.0)), F.lit(floor))
    return both.select("bin", e.alias("expected"), a.alias("actual"), ((a - e) * F.log(a / e)).alias("psi"))


def rate_shift(df: DataFrame, period: Column, event: Column) -> DataFrame:
    """Rows and event rate per period and the relative change from the period before (few periods)."""
    rates = df.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.avg(event.cast("double")).alias("rate"))
    before = F.lag("rate").over(Window.orderBy("period"))
    return rates.withColumn("change_pct", 100 * _share(F.col("rate") - before, before))


def volume_anomalies(df: DataFrame, time: str) -> DataFrame:
    """Rows per day and their distance from the mean in standard deviations (one row per day)."""
    daily = df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    all_days = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sigma = F.stddev("n").over(all_days)
    return daily.withColumn("sigmas", F.when(sigma > 0, (F.col("n") - F.avg("n").over(all_days)) / sigma))


def metric_by(parts: dict[str, DataFrame], label: str = "part") -> DataFrame:
    """Stack one-row metric tables under a label."""
    return reduce(DataFrame.unionByName, [df.withColumn(label, F.lit(name)) for name, df in parts.items()])
