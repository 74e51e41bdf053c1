"""Near-duplicate vectors by p-stable hashing for Euclidean distance, checked by exact cosines.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. A table hashes them by ``width`` quantised Gaussian projections,
floor((g.x + shift) / step); vectors in one bucket of any of ``tables`` tables are candidates. With the defaults a
pair at cosine 0.93 meets with probability 0.95, one at 0.97 with 0.999 (each projection agrees with probability
0.85 and 0.90); an unrelated pair meets in one table with 0.0031 for each pair of vectors.

Equal vectors with equal labels are one class, hashed once. Only buckets that hold two classes or more see their
vectors; a bucket of more than ``bucket_rows`` classes is cut in chunks and each pair of chunks is a task's work,
so nothing is dropped and no task holds a large bucket. A pair that meets in several tables counts in the first of
them. A task forwards link counts and one chain of links per component in its bucket, never all pairs.

Vectors are compared only when their labels are equal and not null. Vectors that are null, empty, zero, or hold
null or non-finite components link with nothing; so do vectors of different lengths with each other. Repeated rows
(equal ids too) are linked copies of each other and each gives a row. A null id keeps a null component unless
linked ids exist.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import arrow_of, importable
from .components import components
from .hashing import mix
from .vectors import finite, numbers, packed_vectors, stacked


def signatures(unit: np.ndarray, tables: int, width: int, step: float, seed: int = 11) -> np.ndarray:
    """A 64-bit bucket number per vector and table."""
    draw = np.random.default_rng([seed, unit.shape[1]])
    lines = draw.standard_normal((unit.shape[1], tables * width))
    shifts = draw.uniform(0, step, tables * width)
    cells = np.floor((unit @ lines + shifts) / step).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, width)
    out = np.zeros(cells.shape[:2], np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
    return out


def _labels(links: np.ndarray) -> np.ndarray:
    """The least index that links lead to, for a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        spread = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        spread = spread[spread]
        if (spread == label).all():
            return label
        label = spread


def near_vectors(
    df: DataFrame, threshold: float = 0.93, tables: int = 10, width: int = 8, step: float = 2.0,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", bucket_rows: int = 2048,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row (under the name ``key``). Starts jobs."""
    importable(df.sparkSession)
    rows = df.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")
    )
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("v", F.when(finite("v") & F.col("label").isNotNull(), F.col("v")))
    rows = rows.withColumn("v", F.when((length > 0) & (length < float("inf")), F.col("v")))
    # -0.0 and 0.0 are one number
    same = F.sha2(F.to_json(F.struct(F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "label")), 256)
    rows = materialize(rows.withColumn("class", F.when(F.col("v").isNotNull(), same)), "vectors")
    classes = (
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("some"), F.any_value("v").alias("any"))
        .select(F.xxhash64("class").alias("id"), "class", "first", "n", F.coalesce("some", "any").alias("v"))
    )
    classes = materialize(classes, "classes")

    def hashed(batch: pa.RecordBatch):
        ids, names, counts, vectors, marks = [], [], [], [], []
        values = numbers(batch.column(3))
        for dims in {len(v) for v in values}:
            own = [i for i, v in enumerate(values) if len(v) == dims]
            unit = np.array([values[i] for i in own])
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            marks += [x.tobytes() for x in signatures(unit, tables, width, step)]
            vectors += [values[i].tobytes() for i in own]
            for out, c in ((ids, 0), (names, 1), (counts, 2)):
                column = batch.column(c).to_pylist()
                out += [column[i] for i in own]
        return [ids, names, counts, vectors, marks]

    labelled = classes.join(rows.groupBy("class").agg(F.any_value("label").cast("string").alias("kind")), "class")
    hashes = packed_vectors(
        labelled.select("id", "kind", "n", "v"), "id bigint, kind string, n bigint, v binary, marks binary", hashed
    )
    hashes = materialize(hashes, "signatures")
    bucket = F.posexplode(F.expr(f"transform(sequence(0, {tables - 1}), t -> substring(marks, 8 * t + 1, 8))"))
    placed = hashes.select("id", F.xxhash64("kind", F.length("v")).alias("kind"), bucket.alias("t", "mark"))
    full = placed.groupBy("kind", "t", "mark").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    placed = placed.join(full, ["kind", "t", "mark"])
    chunks = F.ceil(F.col("rows") / bucket_rows).cast("int")
    placed = placed.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("id"), chunks).cast("int")})
    # each chunk meets every other of its bucket in one group, named by the smaller and the larger
    meets = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = placed.withColumn("other", meets).select(
        "id", "kind", "t", "mark", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    )
    members = placed.join(hashes.select("id", "n", "v", "marks"), "id")
    schema = "a bigint, b bigint, links bigint"
    target = arrow_of(schema)

    def verify(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in ("id", "n", "t", "chunk", "lo", "hi")}
        ids, n, chunk = (np.array(columns[x], np.int64) for x in ("id", "n", "chunk"))
        t, lo, hi = (columns[x][0] for x in ("t", "lo", "hi"))
        x = stacked(table.column("v").to_pylist(), np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        marks = stacked(table.column("marks").to_pylist(), np.uint64)
        links = unit @ unit.T >= threshold
        np.fill_diagonal(links, False)
        if lo != hi:
            links &= chunk[:, None] != chunk[None, :]
        for earlier in range(t):
            links &= marks[:, earlier][:, None] != marks[:, earlier][None, :]
        counts = links @ n
        label = ids[_labels(links)]
        some = counts > 0
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (ids[some], label[some], counts[some])], schema=target)

    found = members.groupBy("kind", "t", "mark", "lo", "hi").applyInArrow(verify, schema)
    found = materialize(found, "links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"))
    of_class = (
        classes.select("id", "class", "first", "n")
        .join(counts, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(least, "component").select(
        "class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    out = rows.select("vec_id", "class").join(of_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def meeting_chance(cosine: float, tables: int = 10, width: int = 8, step: float = 2.0) -> float:
    """Probability that a pair at this cosine meets in some table."""
    from math import erf, exp, pi

    ratio = step / sqrt(max(2 - 2 * cosine, 1e-12))
    tail = (1 - erf(ratio / sqrt(2))) / 2
    one = 1 - 2 * tail - 2 / (sqrt(2 * pi) * ratio) * (1 - exp(-ratio * ratio / 2))
    return 1 - (1 - one**width) ** tables
