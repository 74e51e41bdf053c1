"""Global order, ranks, running totals and exact percentiles without a single-task window.

An unpartitioned window, or one partitioned by a key that holds a third of all rows, lands in one task.
Here the rows are range-partitioned on (partition columns, order columns) into blocks, so that equal keys
may spread over many blocks; each block computes its own running values, and the totals of the blocks
before it are added from a table whose size is bounded by the number of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import matched
from .materialize import materialize

SMALL_ROWS = 200_000  # a table of at most this many rows may be ordered in one task
BLOCK = "_block"
_POSITION = "_position"
_POSITION_BITS = 33  # monotonically_increasing_id: partition in the upper 31 bits, row in the lower 33


def _columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def known(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither null nor NaN; these have no place in an order of values."""
    return df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))


def staged(df: DataFrame) -> tuple[DataFrame, bool]:
    """Write an aggregate once and tell whether it is small enough to be ordered in one task."""
    table = materialize(df, "aggregate")
    return table, table.count() <= SMALL_ROWS


def range_blocks(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Sort ``df`` by ``order`` across blocks; adds ``_block`` and the row's 0-based ``_position`` in it."""
    keys = _columns(order)
    row_id = F.monotonically_increasing_id()
    out = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row_id", row_id)
        .withColumn(BLOCK, F.shiftright("_row_id", _POSITION_BITS).cast("int"))
        .withColumn(_POSITION, F.col("_row_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_row_id")
    )
    return materialize(out, "blocks")


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1-based rank of every row in the total order ``order`` (give a unique last key)."""
    blocks = range_blocks(df, order)
    # one row per block: bounded by the shuffle partition count, whatever the data size
    offsets = (
        blocks.groupBy(BLOCK)
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select(BLOCK, "_before")
    )
    return (
        blocks.join(F.broadcast(offsets), BLOCK)
        .withColumn(name, F.col("_before") + F.col(_POSITION) + 1)
        .drop(BLOCK, _POSITION, "_before")
    )


def running(
    df: DataFrame,
    order: Sequence[str | Column],
    *,
    partition: Sequence[str] = (),
    sums: dict[str, str | Column] | None = None,
    maxima: dict[str, str | Column] | None = None,
    last: dict[str, str | Column] | None = None,
    prior: bool = False,
    small: bool = False,
) -> DataFrame:
    """Running sums, maxima and last non-null values per ``partition`` in ``order``.

    The frame is every row up to and including the current one, or strictly before it with ``prior``.
    Equal order keys are treated as separate rows, so give a unique order inside each partition. Sums keep
    the type of their input column. ``small`` says that the row count was checked (see ``staged``); a
    plain window does then.
    """
    sums, maxima, last = sums or {}, maxima or {}, last or {}
    partition = list(partition)
    if small:
        return _running_small(df, order, partition, sums, maxima, last, prior)
    staged = df
    for name, value in {**sums, **maxima, **last}.items():
        staged = staged.withColumn(f"_in_{name}", F.col(value) if isinstance(value, str) else value)
    blocks = range_blocks(staged, [*partition, *order])

    in_block = Window.partitionBy(*partition, BLOCK).orderBy(_POSITION)
    frame = in_block.rowsBetween(Window.unboundedPreceding, -1 if prior else 0)
    before = (Window.partitionBy(*partition) if partition else Window).orderBy(BLOCK)
    before = before.rowsBetween(Window.unboundedPreceding, -1)

    totals = [F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums]
    totals += [F.max(f"_in_{n}").alias(f"_tot_{n}") for n in maxima]
    totals += [
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(_POSITION))).alias(f"_tot_{n}")
        for n in last
    ]
    per_block = blocks.groupBy(*partition, BLOCK).agg(*totals)
    carries = [F.sum(f"_tot_{n}").over(before).alias(f"_carry_{n}") for n in sums]
    carries += [F.max(f"_tot_{n}").over(before).alias(f"_carry_{n}") for n in maxima]
    carries += [F.last(f"_tot_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in last]
    carry = per_block.select(
        *[F.col(p).alias(f"_key_{p}") for p in partition],
        F.col(BLOCK).alias("_key_block"),
        *carries,
        F.row_number().over((Window.partitionBy(*partition) if partition else Window).orderBy(BLOCK)).alias("_nth"),
    ).where(F.col("_nth") > 1)
    # A block needs a carry only for a key that began in an earlier block. Blocks are ranges of
    # (partition, order), so that can only be its first key: at most one row per block.
    on = F.col(BLOCK) == F.col("_key_block")
    for p in partition:
        on = on & F.col(p).eqNullSafe(F.col(f"_key_{p}"))
    out = blocks.join(F.broadcast(carry), on, "left")

    types = {f.name: f.dataType for f in staged.schema.fields}
    result = [F.col(c) for c in df.columns]
    for name in sums:
        here = F.sum(f"_in_{name}").over(frame)
        total = F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) + F.coalesce(here, F.lit(0))
        result.append(total.cast(types[f"_in_{name}"]).alias(name))
    for name in maxima:
        result.append(F.greatest(F.col(f"_carry_{name}"), F.max(f"_in_{name}").over(frame)).alias(name))
    for name in last:
        here = F.last(f"_in_{name}", ignorenulls=True).over(frame)
        result.append(F.coalesce(here, F.col(f"_carry_{name}")).alias(name))
    return out.select(*result)


def _running_small(df, order, partition, sums, maxima, last, prior) -> DataFrame:
    window = (Window.partitionBy(*partition) if partition else Window).orderBy(*_columns(order))
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if prior else 0)
    new = {}
    for name, value in sums.items():
        value = F.col(value) if isinstance(value, str) else value
        kind = df.select(value.alias("v")).schema["v"].dataType
        new[name] = F.coalesce(F.sum(value).over(frame), F.lit(0)).cast(kind)
    for name, value in maxima.items():
        new[name] = F.max(value).over(frame)
    for name, value in last.items():
        new[name] = F.last(value, ignorenulls=True).over(frame)
    return df.withColumns(new)


def exact_percentiles(
    df: DataFrame, value: str, probabilities: Sequence[float], *, by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated percentiles ``p0, p1, ...`` of the non-null values, per ``by`` group.

    Works on the distinct values with their counts, so a hot value is one row, and needs no task to hold
    all values of a group (the built-in exact ``percentile`` does).
    """
    by = list(by)
    counts, small = staged(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    )
    ranked = running(counts, [value], partition=by, sums={"_upto": "_n"}, small=small)
    ranked = ranked.withColumn("_from", F.col("_upto") - F.col("_n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
        ranked = matched(ranked, totals, by)
        size = F.col("_total")
    else:
        size = F.lit(ranked.agg(F.coalesce(F.max("_upto"), F.lit(0))).first()[0])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col(value)))

    picks = []
    for i, p in enumerate(probabilities):
        position = (size - 1) * F.lit(float(p))
        picks += [
            at(F.floor(position)).cast("double").alias(f"_lo{i}"),
            at(F.ceil(position)).cast("double").alias(f"_hi{i}"),
            F.max(position - F.floor(position)).alias(f"_frac{i}"),
        ]
    picked = ranked.groupBy(*by).agg(*picks)
    return picked.select(
        *by,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_frac{i}")).alias(f"p{i}")
            for i in range(len(probabilities))
        ],
    )


def percentile_values(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float | None]:
    """Whole-table percentiles as plain numbers (one row comes to the driver)."""
    return list(exact_percentiles(df, value, probabilities).first())
