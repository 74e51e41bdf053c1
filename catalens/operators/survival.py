"""Cohorts, survival fields and curves, follow-up accounting and data checks for time-to-event data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grouped import matched
from ..plans.ordered import exact_percentiles, known, running, staged

Z95 = 1.959963984540054  # fixed value: 97.5 % point of the normal distribution


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def cohort(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that pass every step."""
    return df.where(reduce(lambda a, b: a & b, [_holds(c) for _, c in steps]))


def cohort_flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step and rows it removed, all steps counted in one pass."""
    passed = F.lit(True)
    entries = [F.struct(F.lit(0).alias("step"), F.lit("initial").alias("name"), F.count("*").alias("remaining"))]
    for i, (name, condition) in enumerate(steps, 1):
        passed = passed & _holds(condition)
        entries.append(
            F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(passed).alias("remaining"))
        )
    flow = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    previous = F.lag("remaining").over(Window.orderBy("step"))  # as many rows as there are steps
    return flow.withColumn("excluded", F.coalesce(previous - F.col("remaining"), F.lit(0)))


def survival_fields(df: DataFrame, *, entity: str, time: str, cutoff: Column) -> DataFrame:
    """Per entity first and last activity, ``event`` (inactive since before the cut-off) and ``duration`` in days."""
    return (
        df.groupBy(entity)
        .agg(F.min(time).alias("first_dt"), F.max(time).alias("last_dt"))
        .withColumn("event", (F.col("last_dt") < cutoff).cast("int"))
        .withColumn("duration", F.datediff("last_dt", "first_dt").cast("long"))
    )


def survival_checks(df: DataFrame, duration: str, event: str, *, minimum: float = 0) -> DataFrame:
    """One row of data checks: no negative durations, binary event, durations not below the minimum."""
    odd = F.col(event).isNull() | ~F.col(event).isin(0, 1)
    return df.agg(
        (F.count_if(F.col(duration) < 0) == 0).alias("no_negative_durations"),
        (F.count_if(odd) == 0).alias("binary_event"),
        (F.count_if(F.col(duration) < minimum) == 0).alias("above_min_duration"),
    )


# --- curves -----------------------------------------------------------------------------------------


def _risk_table(df: DataFrame, duration: str, by: list[str], counts: dict[str, Column]):
    """Per (group, distinct time): the counts, rows, and how many were at risk just before it."""
    per_time, small = staged(
        df.where(F.col(duration).isNotNull())
        .groupBy(*by, F.col(duration).alias("time"))
        .agg(F.count("*").alias("n"), *[c.alias(name) for name, c in counts.items()])
    )
    # times in falling order: everyone with the same or a longer duration is at risk
    out = running(per_time, [F.col("time").desc()], partition=by, sums={"at_risk": "n"}, small=small)
    return out, small


def _survival_terms(events: str):
    d, n = F.col(events), F.col("at_risk")
    log_term = F.when(d < n, F.log1p(-d / n)).otherwise(F.lit(0.0))
    ended = (d == n).cast("int")
    return log_term, ended


def kaplan_meier(df: DataFrame, duration: str, event: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Product-limit curve with Greenwood 95 % limits (log-log form), per group.

    ``time, at_risk, events, censored, survival, ci_lower, ci_upper`` for every distinct time.
    """
    by = list(by)
    table, small = _risk_table(df, duration, by, {"events": F.sum(F.col(event).cast("long"))})
    log_term, ended = _survival_terms("events")
    d, n = F.col("events"), F.col("at_risk")
    variance = F.when(d < n, d / (n * (n - d))).otherwise(F.lit(0.0))
    curve = running(
        table, ["time"], partition=by, sums={"_log": log_term, "_var": variance}, maxima={"_ended": ended}, small=small
    )
    survival = F.when(F.col("_ended") == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    flat = (F.col("_ended") == 1) | (F.col("_log") == 0)  # at 1 and 0 the limits meet the curve
    width = F.lit(Z95) * F.sqrt("_var") / F.col("_log")
    centre = F.log(-F.col("_log"))

    def limit(sign: int) -> Column:
        return F.when(flat, survival).otherwise(F.exp(-F.exp(centre + sign * width)))

    return curve.select(
        *by, "time", "at_risk", "events", (F.col("n") - F.col("events")).alias("censored"),
        survival.alias("survival"), F.least(limit(1), limit(-1)).alias("ci_lower"),
        F.greatest(limit(1), limit(-1)).alias("ci_upper"),
    )


def cumulative_incidence(
    df: DataFrame, duration: str, cause: str, causes: Sequence[int], *, by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative incidence of each competing cause (cause 0 is censoring), one row per time and cause."""
    by = list(by)
    counts = {f"d{k}": F.count_if(F.col(cause) == k) for k in causes}
    table, small = _risk_table(df, duration, by, {**counts, "events": F.count_if(F.col(cause).isin(list(causes)))})
    log_term, ended = _survival_terms("events")
    before = running(
        table, ["time"], partition=by, sums={"_log": log_term}, maxima={"_ended": ended}, prior=True, small=small
    ).withColumn(
        "_before", F.when(F.coalesce(F.col("_ended"), F.lit(0)) == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    )
    steps = {f"c{k}": F.col("_before") * F.col(f"d{k}") / F.col("at_risk") for k in causes}
    total = running(before.drop("_log", "_ended"), ["time"], partition=by, sums=steps, small=small)
    per_cause = F.array(
        *[
            F.struct(
                F.lit(k).alias("cause"), F.col(f"d{k}").alias("events"), F.col(f"c{k}").alias("cumulative_incidence")
            )
            for k in causes
        ]
    )
    return total.select(*by, "time", "at_risk", F.inline(per_cause))


# --- descriptive tables -----------------------------------------------------------------------------


def duration_stats(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Number, mean, median, minimum and maximum duration of events and of censored rows."""
    plain = df.groupBy(event).agg(
        F.count("*").alias("n"), F.avg(duration).alias("mean_duration"),
        F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"),
    )
    median = exact_percentiles(df, duration, [0.5], by=[event]).withColumnRenamed("p0", "median_duration")
    return matched(plain, median, [event], "left")


def duration_ecdf(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Share of rows at or below each duration, by event status."""
    per_time, small = staged(df.groupBy(event, duration).agg(F.count("*").alias("n")))
    totals = per_time.groupBy(event).agg(F.sum("n").alias("total"))
    upto = running(per_time, [duration], partition=[event], sums={"upto": "n"}, small=small)
    return matched(upto, totals, [event]).select(event, duration, "n", (F.col("upto") / F.col("total")).alias("ecdf"))


def duration_histogram(df: DataFrame, duration: str, event: str, *, width: float) -> DataFrame:
    """Rows per duration bin of fixed width, by event status."""
    start = F.floor(F.col(duration) / width) * width
    return df.groupBy(event, start.alias("bin_start")).agg(F.count("*").alias("n"))


def followup_bands(df: DataFrame, duration: str, event: str, edges: Sequence[int]) -> DataFrame:
    """Per follow-up band: rows entering it, events, censored rows and the censored share of those entering.

    Bands are (edge, next edge], the first from 0 and the last open; as many rows as there are bands. Rows whose
    duration is null or not a number enter no band.
    """
    df = known(df, duration)
    starts = [0, *edges]
    band = sum((F.when(F.col(duration) > e, 1).otherwise(0) for e in edges), F.lit(0))
    counted = df.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events")
    )
    labels = [f"{s if i == 0 else s + 1}-{edges[i]}" if i < len(edges) else f">{s}" for i, s in enumerate(starts)]
    later = Window.orderBy(F.col("band").desc())
    return (
        counted.withColumn("entering", F.sum("n").over(later))
        .withColumn("censored", F.col("n") - F.col("events"))
        .select(
            F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("band") + 1).alias("band"),
            "entering", "events", "censored",
            (100.0 * F.col("censored") / F.col("entering")).alias("censored_pct"),
        )
    )


def person_time(df: DataFrame, duration: str, event: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows, events, time at risk and event rate per 1,000 time units."""
    total = F.sum(duration)
    events = F.sum(F.col(event).cast("long"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), events.alias("events"), total.alias("person_time"),
        F.when(total > 0, 1000.0 * events / total).alias("rate_per_1000"),
    )


def cohort_summary(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Size, events, censored rows with shares, median follow-up and event rate: one row."""
    base = person_time(df, duration, event)
    median = exact_percentiles(df, duration, [0.5]).first()[0]
    return base.select(
        "n", "events", (100.0 * F.col("events") / F.col("n")).alias("events_pct"),
        (F.col("n") - F.col("events")).alias("censored"), F.lit(median).cast("double").alias("median_followup"),
        "rate_per_1000",
    )


# --- checks -----------------------------------------------------------------------------------------


def duplicate_checks(df: DataFrame, entity: str, event: str) -> DataFrame:
    """Entities with more than one row, and entities with more than one event."""
    per_entity = df.groupBy(entity).agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.col(event).cast("long"), F.lit(0))).alias("events")
    )
    return per_entity.agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("rows") > 1).alias("duplicate_entities"),
        F.count_if(F.col("events") > 1).alias("multiple_event_entities"),
    )


def overlapping_periods(df: DataFrame, entity: str, start: str, end: str, tie: str) -> DataFrame:
    """Risk periods that begin before an earlier period of the same entity has ended."""
    flagged = running(
        df.select(entity, start, end, tie), [start, end, tie], partition=[entity],
        maxima={"previous_end": F.col(end)}, prior=True,
    )
    return flagged.where(F.col(start) < F.col("previous_end"))


def overlap_summary(overlaps: DataFrame, entity: str) -> DataFrame:
    """Overlapping periods per entity."""
    return overlaps.groupBy(entity).agg(F.count("*").alias("overlaps"))


def feature_window_violations(df: DataFrame, feature_time: str, origin: str, lookback_days: int) -> DataFrame:
    """How many feature times lie after the origin or before the lookback window."""
    after = F.col(feature_time) > F.col(origin)
    early = F.col(feature_time) <= F.col(origin) - F.expr(f"interval {lookback_days} days")
    return df.agg(
        F.count("*").alias("rows"), F.count_if(after).alias("after_origin"),
        F.count_if(early).alias("before_window"),
    )


def target_leakage(df: DataFrame, target: str, features: Sequence[str], *, threshold: float = 0.95) -> DataFrame:
    """Correlation of every feature with the target and whether its size exceeds the threshold; one pass."""
    entries = [
        F.struct(F.lit(f).alias("feature"), F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias("r"))
        for f in features
    ]
    rows = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    return rows.withColumn("leaks", F.coalesce(F.abs("r") > threshold, F.lit(False)))


def temporal_split_check(train: DataFrame, test: DataFrame, time: str) -> DataFrame:
    """Whether every test row is later than every training row."""
    parts = train.select(F.col(time).alias("_t"), F.lit(True).alias("_train")).unionByName(
        test.select(F.col(time).alias("_t"), F.lit(False).alias("_train"))
    )
    edges = parts.agg(
        F.max(F.when(F.col("_train"), F.col("_t"))).alias("train_end"),
        F.min(F.when(~F.col("_train"), F.col("_t"))).alias("test_start"),
    )
    return edges.withColumn("in_order", F.col("test_start") > F.col("train_end"))
