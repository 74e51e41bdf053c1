"""Time-aware features: lookback totals, as-of values, person-period rows, transforms and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import percentile_values, running


HUGE = 1e26
FRACTION_BITS = 50


def lookback_features(
    events: DataFrame,
    origins: DataFrame,
    *,
    entity: str,
    time: str,
    origin: str,
    days: Sequence[int],
    value: str | None = None,
) -> DataFrame:
    """Event count (and sum of ``value``) in (origin − n days, origin] for every origin row and window.

    The totals up to both window edges are read off one running total per entity, so each event is handled
    once however many origins and windows cover it, and no event-origin pairs are made. The totals are exact (whole
    numbers and fractions of 2**-FRACTION_BITS), so a large value before a window takes no digits from it; only
    among values of ``HUGE`` and more are doubles subtracted.
    """
    edges = [F.struct(F.lit(0).alias("_back"), F.col(origin).alias("_at"))] + [
        F.struct(F.lit(n).alias("_back"), (F.col(origin) - F.expr(f"interval {n} days")).alias("_at")) for n in days
    ]
    marks = origins.select(entity, origin).distinct().select(entity, origin, F.inline(F.array(*edges)))
    amount = F.col(value).cast("double") if value else F.lit(0.0)
    finite = F.abs(amount) < F.lit(float("inf"))  # false for NaN too, which orders above infinity
    usual = F.when(F.abs(amount) < HUGE, amount).otherwise(0.0)
    whole = F.floor(usual).cast("decimal(38,0)")
    part = F.floor((usual - F.floor(usual)) * 2.0**FRACTION_BITS).cast("decimal(38,0)")
    none = F.lit(0).cast("decimal(38,0)")
    kind = marks.schema[origin].dataType
    sums = {
        "_n": F.count("*"),
        "_whole": F.coalesce(F.sum(whole).cast("decimal(38,0)"), none),
        "_part": F.coalesce(F.sum(part).cast("decimal(38,0)"), none),
        "_huge": F.coalesce(F.sum(F.when(finite & (F.abs(amount) >= HUGE), amount)), F.lit(0.0)),
        "_huges": F.count_if(finite & (F.abs(amount) >= HUGE)),
        "_bad": F.count_if(~finite),
    }
    rows = events.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).groupBy(
        F.col(entity), F.col(time).cast(kind).alias("_at")
    ).agg(*[total.alias(f"_of{name}") for name, total in sums.items()])
    nothing = {f"_of{name}": F.lit(0).cast(rows.schema[f"_of{name}"].dataType) for name in sums}
    timeline = rows.select(
        entity, F.lit(None).cast(kind).alias(origin), F.lit(-1).alias("_back"), "_at", *nothing
    ).unionByName(marks.withColumns(nothing))
    # an event at the very time of an edge counts as before it (_back = -1 sorts first)
    upto = running(
        timeline, ["_at", "_back", origin], partition=[entity], sums={name: f"_of{name}" for name in sums}
    ).where(F.col("_back") >= 0)

    def edge(name: str, back: int) -> Column:
        return F.max(F.when(F.col("_back") == back, F.col(name)))

    features = []
    for n in days:
        features.append((edge("_n", 0) - edge("_n", n)).alias(f"events_{n}d"))
        if value:
            # a value that is not finite spoils the windows that hold it, not all later ones
            spoilt = edge("_bad", 0) > edge("_bad", n)
            exact = (edge("_whole", 0) - edge("_whole", n)).cast("double")
            exact += (edge("_part", 0) - edge("_part", n)).cast("double") / 2.0**FRACTION_BITS
            huge = F.when(edge("_huges", 0) > edge("_huges", n), edge("_huge", 0) - edge("_huge", n)).otherwise(0.0)
            total = exact + huge
            features.append(F.when(spoilt, F.lit(float("nan"))).otherwise(total).alias(f"{value}_{n}d"))
    return upto.groupBy(entity, origin).agg(*features)


def asof_covariate(
    base: DataFrame, covariates: DataFrame, *, entity: str, at: str, time: str, values: Sequence[str]
) -> DataFrame:
    """For every base row the latest covariate row of its entity at or before ``at``.

    Both tables become one ordered timeline per entity and the last covariate is carried forward.
    """
    kind = base.schema[at].dataType
    payload = F.struct(F.col(time).alias("covariate_time"), *values)
    # covariates at the same time: the largest struct, so that the result does not depend on arrival
    latest = covariates.groupBy(F.col(entity), F.col(time).cast(kind).alias(at)).agg(F.max(payload).alias("_known"))
    known_type = latest.schema["_known"].dataType
    asked = base.select(entity, at).distinct()
    timeline = latest.select(entity, at, F.lit(0).alias("_kind"), "_known").unionByName(
        asked.select(entity, at, F.lit(1).alias("_kind"), F.lit(None).cast(known_type).alias("_known"))
    )
    carried = running(timeline, [at, "_kind"], partition=[entity], last={"_as_of": "_known"})
    answers = carried.where(F.col("_kind") == 1).select(entity, at, F.col("_as_of"))
    return base.join(answers, [entity, at], "left").select(
        *base.columns, F.col("_as_of.covariate_time").alias("covariate_time"),
        *[F.col(f"_as_of.{v}").alias(v) for v in values],
    )


def person_period(df: DataFrame, *, duration: str, event: str, width: int) -> DataFrame:
    """One row per entity and interval at risk: ``interval, start, stop`` and the event in the last one."""
    last = F.floor(F.col(duration) / width).cast("int")
    return (
        df.where(F.col(duration) >= 0)
        .withColumn("interval", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("start", (F.col("interval") * width).cast("long"))
        .withColumn("stop", F.least(F.col("start") + width, F.col(duration)).cast("long"))
        .withColumn("interval_event", F.when(F.col("interval") == last, F.col(event)).otherwise(0).cast("int"))
    )


def iqr_bounds(df: DataFrame, column: str, *, factor: float = 1.5) -> tuple[float, float]:
    low, high = percentile_values(df, column, [0.25, 0.75])
    return low - factor * (high - low), high + factor * (high - low)


def outlier_flags(df: DataFrame, column: str, *, factor: float = 1.5) -> DataFrame:
    """Adds ``<column>_outlier``: outside the interquartile fences."""
    low, high = iqr_bounds(df, column, factor=factor)
    return df.withColumn(f"{column}_outlier", (F.col(column) < low) | (F.col(column) > high))


def winsorize(df: DataFrame, column: str, *, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Adds ``<column>_w``: the value pulled to the given percentiles."""
    low, high = percentile_values(df, column, [lower, upper])
    pulled = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high)))
    return df.withColumn(f"{column}_w", pulled)


def log_feature(column: str) -> Column:
    return F.log1p(F.greatest(F.col(column), F.lit(0))).alias(f"log_{column}")


def binned(column: str, cuts: Sequence[float]) -> Column:
    """Number of cuts at or below the value."""
    value = F.col(column)
    index = sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return F.when(value.isNotNull(), index).alias(f"{column}_bin")


def one_hot(column: str, categories: Sequence[str]) -> list[Column]:
    """0/1 column per known category; an unseen or missing value is 0 in all of them."""
    return [
        F.coalesce((F.col(column) == c).cast("int"), F.lit(0)).alias(f"{column}_{c}") for c in categories
    ]


def ordinal(column: str, order: Sequence[str]) -> Column:
    """Position in the given order, null for an unknown value."""
    position = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.nullif(position, F.lit(0)).cast("int").alias(f"{column}_rank")


def encode_categories(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_code``: the 1-based rank of the value among the sorted distinct values, null for null.

    The categories stay a table, however many there are.
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = running(found.withColumn("_one", F.lit(1).cast("long")), [column], sums={f"{column}_code": "_one"})
    return df.join(codes.drop("_one"), column, "left").select(*df.columns, f"{column}_code")


def temporal_split(
    df: DataFrame, time: str, *, train_end: str, valid_end: str | None = None, gap_days: int = 0
) -> DataFrame:
    """Adds ``split``: train, validation, test, or gap for rows within ``gap_days`` after a cut-off."""
    value = F.col(time)

    def at(text: str) -> Column:
        return F.lit(text).cast(df.schema[time].dataType)

    def gap(text: str) -> Column:
        return at(text) + F.expr(f"interval {gap_days} days")

    label = F.when(value <= at(train_end), "train").when(value <= gap(train_end), "gap")
    if valid_end:
        label = label.when(value <= at(valid_end), "validation").when(value <= gap(valid_end), "gap")
    return df.withColumn("split", F.when(value.isNotNull(), label.otherwise("test")))


def split_summary(split: DataFrame, time: str, event: str) -> DataFrame:
    """Rows, events and time range per split."""
    return split.groupBy("split").agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"),
        F.min(time).alias("start"), F.max(time).alias("end"),
    )
