"""Per-group heads and bounded nested arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: the largest k that Spark's window group limit prunes in the map tasks.
GROUP_LIMIT = 1000
SALTS = 64


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the result has the keys once."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(other, on, how).drop(*(f"_right_{k}" for k in keys))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``_nth``.

    Spark prunes every map partition to ``k`` rows per group before the shuffle (WindowGroupLimit), so a
    hot group never travels whole. It does so up to k = 1000; for a larger ``k`` groups are first pruned in
    ``SALTS`` parts.
    """
    if k > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_nth", F.row_number().over(part)).where(F.col("_nth") <= k).drop("_salt", "_nth")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= k)


def nested_parts(df: DataFrame, keys: Sequence[str], item: Column, spread: Column, parts: int = 1) -> DataFrame:
    """Collect ``item`` per group into ``parts`` sorted arrays, numbered in ``part``.

    Every group is split by the hash of ``spread``, whatever its size; a part without rows is left out. The
    shuffle is on (keys, part), so ``parts`` bounds what a task holds of a large group.
    """
    return (
        df.select(*keys, item.alias("_item"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int").alias("part"))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list("_item")).alias("items"))
    )
