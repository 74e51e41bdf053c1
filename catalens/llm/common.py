"""Input selection, bounded word caches and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, if they see that folder."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def two_columns(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key bigint, text string)`` of a table, under fixed names whatever else it holds."""
    importable(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("key"), F.col(value).cast("string").alias("text"))


def text_rows(
    df: DataFrame, key: str, value: str, work: Callable[[list[str]], list[tuple]], columns: str
) -> DataFrame:
    """One output row ``(key, *work)`` per input row; ``work`` maps a list of texts (null is '') to tuples.

    A narrow transformation: each task streams its own rows, a lost task is simply run again.
    """
    schema = f"`{key}` bigint, {columns}"
    target = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch):
                rows = work([x or "" for x in part.column(1).to_pylist()])
                values = list(zip(*rows)) or [()] * (len(target) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, f.type) for v, f in zip(values, list(target)[1:]))], schema=target
                )

    return two_columns(df, key, value).mapInArrow(run, schema)


def small_slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one at a time, for rows of megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def among(rows: DataFrame, number: Column, kept: Column, of: DataFrame) -> DataFrame:
    """The rows whose ``number`` (not negative) is one of ``kept`` in ``of``; no row is shuffled.

    Every executor gets the numbers as bitmaps, an eighth of a byte for each number up to the largest of a range of
    32,768, so that numbers should lie close together.
    """
    maps = of.select(F.bitmap_bucket_number(kept).alias("_bucket"), F.bitmap_bit_position(kept).alias("_bit"))
    maps = maps.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    place = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(number) == F.col("_bucket"))
    return met.where(F.getbit(byte, place % 8) == 1).select(*(F.col(f"`{c}`") for c in rows.columns))


def arrow_of(ddl: str) -> pa.Schema:
    """Arrow form of a Spark DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def reclaim(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that nothing refers to any more.

    Its cleaner acts on the driver's garbage collection, which a short driver program may never reach.
    """
    for _ in range(2):  # plans that refer to each other need a second turn
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


class WordCache(dict):
    """Results per word, emptied when it is full; a worker process keeps one per model across its tasks."""

    def __init__(self, limit: int = 800_000):
        super().__init__()
        self.limit = limit

    def make_room(self) -> None:
        if len(self) > self.limit:
            self.clear()


class RecentWords(dict):
    """Results per word, made by ``make`` where they are missing; of ``limit`` to twice as many words the latest stay.

    Results of words of more than ``longest`` characters are not kept.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > self.longest:
                return found
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def forget(self) -> None:
        self.older = {}
        self.clear()
