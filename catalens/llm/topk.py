"""Exact top-k inner-product search by a vector-approximation file.

Every component becomes the integer floor(scale * x). The approximation file keeps one byte per component, the
number of its cell between marks learnt from at most ``sample_rows`` rows (a documented bound; the marks change
speed, never results), in blocks of many vectors. Blocks of queries scan blocks of cells: the cells' edges bound
every score from below and above by two matrix products, and a pair passes if its upper bound reaches the k-th
best lower bound of its query in that block. Of what passes, the exact vectors are read in the order of the
bounds: first the k best upper bounds of each query, whose k-th exact score then shows which others can still
matter; once those are read, the result is certain.

Equal vectors are one candidate with its ``k + 1`` smallest ids, since a query can use no more of them; so a
vector that a third of all rows share costs no more than any other. Ties go to the smaller id.
Vectors that are null, empty or hold null or non-finite components take no part, nor do those whose id is null.
Vectors with scaled components beyond +-2**24 (wide ones) have blocks and marks of their own, as whole numbers in
64-bit floats; bounds are widened where floats round, and their scores are sums of Python's integers. A scaled
component beyond the floats or a score beyond 64 bits that has to be computed is an error, never a row less.
Rows with equal ids and vectors count one by one, as queries (each lists every candidate) and as candidates.
Vectors are compared only with vectors of their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import arrow_of, importable
from .vectors import finite, numbers, packed_vectors, stacked

BOUND = 1 << 24
CELLS = 64
INTS = "vec_id bigint, dims int, ints binary"
LARGE = 1e300  # marks stay within it, so that their differences are finite


def integers(df: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``vec_id, dims, ints, copies``: the usable vectors as packed whole numbers, and how many rows hold each.

    Numbers of up to ``BOUND`` are 32-bit integers; if one is beyond it, all of the vector are 64-bit floats.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite("v"))

    def make(batch: pa.RecordBatch):
        ids, dims, ints = [], [], []
        for vec_id, v in zip(batch.column(0).to_pylist(), numbers(batch.column(1))):
            with np.errstate(over="ignore"):
                v = np.floor(scale * v) + 0.0  # no negative zero
            most = np.abs(v).max()
            if most == np.inf:
                raise OverflowError(f"vector {vec_id}: a component times {scale} is beyond 64-bit floats")
            ids.append(vec_id)
            dims.append(len(v))
            ints.append(v.astype("<i4" if most <= BOUND else "<f8").tobytes())
        return [ids, dims, ints]

    return packed_vectors(rows, INTS, make).groupBy("vec_id", "dims", "ints").agg(F.count("*").alias("copies"))


def is_wide(ints: bytes, dims: int) -> bool:
    return len(ints) != 4 * dims


def unpacked(ints: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(ints, "<f8" if is_wide(ints, dims) else "<i4")


def matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    """Packed vectors, wide ones or not, as rows of floats."""
    if not any(is_wide(x, dims) for x in blobs):
        return stacked(blobs, "<i4").astype(np.float64)
    return np.stack([unpacked(x, dims).astype(np.float64) for x in blobs])


def product(a: bytes, b: bytes, dims: int) -> int:
    """The exact inner product, which has to fit into 64 bits."""
    x, y = unpacked(a, dims), unpacked(b, dims)
    if not (is_wide(a, dims) or is_wide(b, dims)) and dims < 1 << 15:
        return int(x.astype(np.int64) @ y.astype(np.int64))
    score = sum(int(p) * int(q) for p, q in zip(x.tolist(), y.tolist()))
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"inner product {score} is beyond 64 bits")
    return score


def cell_marks(vectors: DataFrame, sample_rows: int) -> dict[tuple[int, bool], np.ndarray]:
    """Per vector length, wide or not: ``CELLS + 1`` marks per component, from a sample of bounded size."""
    sample = vectors.orderBy(F.xxhash64("vec_id")).limit(sample_rows).collect()
    kinds: dict[tuple[int, bool], list] = {}
    for r in sample:
        kinds.setdefault((r.dims, is_wide(r.ints, r.dims)), []).append(r.ints)
    out = {}
    for kind, blobs in kinds.items():
        rows = np.clip(matrix(blobs, kind[0]), -LARGE, LARGE)
        out[kind] = np.maximum.accumulate(np.quantile(rows, np.linspace(0, 1, CELLS + 1), axis=0))
    return out


def _edges(cells: np.ndarray, marks: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Least and greatest integer of each cell; the outer cells reach to the block's own extremes."""
    inner_low, inner_high = np.ceil(marks[:-1]), np.floor(marks[1:])
    inner_low[0], inner_high[-1] = np.minimum(low, inner_high[0]), np.maximum(high, inner_low[-1])
    columns = np.arange(cells.shape[1])
    return inner_low[cells, columns], inner_high[cells, columns]


def bounds_of(asks: np.ndarray, under: np.ndarray, over: np.ndarray):
    """Bounds of the inner products of ``asks`` with vectors between ``under`` and ``over``, safe against rounding."""
    dims = asks.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        middle, half = under / 2 + over / 2, over / 2 - under / 2
        centre, width = asks @ middle.T, np.abs(asks) @ half.T
        reach = np.maximum(np.abs(under), np.abs(over))
        if np.abs(asks).max() * reach.max() * dims >= 2.0**51:  # else all sums are exact
            width = width + (dims + 8) * 2.0**-50 * (np.abs(asks) @ reach.T)
        return np.nan_to_num(centre - width, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(
            centre + width, nan=np.inf, posinf=np.inf, neginf=-np.inf
        )


def approximation_file(vectors: DataFrame, marks: dict, block_rows: int) -> DataFrame:
    """``dims, wide, heads, ids, sole, cells, low, high``: blocks of the distinct vectors' cells.

    ``ids`` has the least id of each vector, ``sole`` whether it is the only one.
    """
    schema = "dims int, wide boolean, heads binary, ids binary, sole binary, cells binary, low binary, high binary"
    target = arrow_of(schema)

    def blocks(batches):
        waiting: dict[tuple[int, bool], list] = {}

        def row(kind):
            heads, ids, more, ints = zip(*waiting.pop(kind))
            dims, wide = kind
            values = matrix(ints, dims)
            edges = marks.get(kind, np.zeros((CELLS + 1, dims)))
            cells = np.empty(values.shape, np.uint8)
            for c in range(dims):
                cells[:, c] = np.searchsorted(edges[1:-1, c], values[:, c], "right")
            out = [dims, wide, np.array(heads).tobytes(), np.array(ids).tobytes(), (~np.array(more)).tobytes(), cells.tobytes()]
            out += [x.tobytes() for x in (values.min(0), values.max(0))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, target)], schema=target)

        for batch in batches:
            for head, vec_id, more, dims, ints in zip(*(batch.column(i).to_pylist() for i in range(5))):
                kind = dims, is_wide(ints, dims)
                waiting.setdefault(kind, []).append((head, vec_id, more, ints))
                if len(waiting[kind]) >= block_rows:
                    yield row(kind)
        for kind in list(waiting):
            yield row(kind)

    return vectors.mapInArrow(blocks, schema)


def top_k(
    df: DataFrame, every: int, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
    sample_rows: int = 4096, block_rows: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose id is divisible by ``every``, the best other rows.

    Starts jobs; what several branches read is written to the shared folder.
    """
    spark = df.sparkSession
    importable(spark)
    vectors = materialize(integers(df, scale, key, vector), "vectors")
    equal = Window.partitionBy("dims", "ints").orderBy("vec_id")
    few = vectors.withColumn("_nth", F.row_number().over(equal)).where(F.col("_nth") <= k + 1)
    few = few.withColumn("_row", F.monotonically_increasing_id())
    few = few.withColumns({"head": F.first("_row").over(equal), "more": F.lead("vec_id").over(equal).isNotNull()})
    few = materialize(few.drop("_row"), "distinct")
    heads = few.where("_nth = 1")
    marks = cell_marks(heads, sample_rows)
    file = approximation_file(heads.select("head", "vec_id", "more", "dims", "ints"), marks, block_rows)
    per_block = max(256, block_rows // 8)
    queries = vectors.where(F.col("vec_id") % every == 0).withColumn("ask", F.monotonically_increasing_id())
    queries = materialize(queries, "queries")
    groups = -(-queries.count() // per_block) or 1
    asked = (
        queries.withColumn("group", F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int"))
        .groupBy("dims", "group")
        .agg(F.collect_list(F.struct("ask", "vec_id", "ints")).alias("queries"))
    )
    faced = file.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(asked, ["dims", "group"])
    schema = "ask bigint, head bigint, low double, high double"

    def scan(batch: pa.RecordBatch):
        out = [[], [], [], []]
        for row in batch.to_pylist():
            dims, kind = row["dims"], (row["dims"], row["wide"])
            heads, ids = (np.frombuffer(row[x], np.int64) for x in ("heads", "ids"))
            sole = np.frombuffer(row["sole"], bool)
            low, high = (np.frombuffer(row[x], np.float64) for x in ("low", "high"))
            cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dims)
            under, over = _edges(cells, marks.get(kind, np.zeros((CELLS + 1, dims))), low, high)
            for at in range(0, len(row["queries"]), 256):
                some = row["queries"][at : at + 256]
                least, most = bounds_of(matrix([q["ints"] for q in some], dims), under, over)
                # a vector that only the query's own id has is no candidate
                use = ~(sole & (ids == np.array([x["vec_id"] for x in some])[:, None]))
                least = np.where(use, least, -np.inf)
                bar = np.partition(least, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(some), -np.inf)
                q, c = np.nonzero(use & (most >= bar[:, None]))
                for column, values in zip(out, (np.array([x["ask"] for x in some])[q], heads[c], least[q, c], most[q, c])):
                    column.append(values)
        return [np.concatenate(x) if x else [] for x in out]

    bounds = materialize(packed_vectors(faced, schema, scan), "bounds")
    by_low = Window.partitionBy("ask").orderBy(F.desc("low"), "head")
    bar = bounds.withColumn("_nth", F.row_number().over(by_low)).where(F.col("_nth") == k)
    bar = bar.select("ask", F.col("low").alias("bar"))
    possible = materialize(
        bounds.join(bar, "ask", "left").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).drop("bar"),
        "possible",
    )

    exact_schema = "ask bigint, head bigint, score bigint"

    def dots(batch: pa.RecordBatch):
        q, h, a, b, dims = (batch.column(i).to_pylist() for i in range(5))
        return [q, h, [product(*x) for x in zip(a, b, dims)]]

    asks = queries.select("ask", F.col("ints").alias("a"))
    right = heads.select("head", F.col("ints").alias("b"), "dims")

    def exact(pairs: DataFrame) -> DataFrame:
        joined = pairs.select("ask", "head").join(asks, "ask").join(right, "head")
        return packed_vectors(joined.select("ask", "head", "a", "b", "dims"), exact_schema, dots)

    by_high = Window.partitionBy("ask").orderBy(F.desc("high"), "head")
    ranked = possible.withColumn("_nth", F.row_number().over(by_high))
    first = materialize(exact(ranked.where(F.col("_nth") <= k)), "first")
    known = first.groupBy("ask").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    rest = ranked.where(F.col("_nth") > k).join(known.where(F.col("n") >= k), "ask")
    scores = first.unionByName(exact(rest.where(F.col("high") >= F.col("least"))))

    # the ids of equal vectors, at most k + 1 per head, each as often as rows of the query and rows of the id pair up
    copies = few.select("head", "vec_id", F.least("copies", F.lit(k)).alias("copies"))
    own = queries.select("ask", F.col("vec_id").alias("query_id"), F.least("copies", F.lit(k)).alias("times"))
    times = F.explode(F.sequence(F.lit(1), F.least(F.col("copies") * F.col("times"), F.lit(k)).cast("int")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        scores.join(copies, "head").join(own, "ask")
        .where(F.col("vec_id") != F.col("query_id"))
        .select("query_id", "vec_id", "score", times)
        .withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
