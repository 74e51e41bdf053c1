"""Ranked lexical search: exact inner products of sparse vectors over ball trees.

A document's vector holds one whole number per term, (10**9 * tf) div (1000 * tf + 12 * m) with m its relative
length; a query's holds weight times occurrences. Their inner product is the score. Only the terms that the
queries use can add to it, so the index keeps the documents' entries for those.

The index is a table of blocks of documents. A task builds a ball tree per block: nodes are halved along the line
between two far members until a leaf is small or its members are equal; every node has a centroid and a radius.
No member can score more than ``q . centroid + |q| * radius`` (in coordinates scaled by the root of the weights),
widened for rounding. Every query walks a block's tree best bound first and stops where the bound is below the
k-th best score it has seen in the task; leaves are scored exactly, in 64-bit integers. A task hands on k rows per
query, ranked first in salted parts, then whole.

Queries go in batches of bounded size, each over all documents. Null texts have no term and are never found, nor
counted. Documents with a null id take part; of equal scores they come last. Repeated rows and ids of documents
each count; repeated rows of items each give their own ranking. An item without terms, or an empty table, gives
no row. Other columns are ignored. Scores are 64-bit: an item may have some 10**8 terms.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grouped import first_per_group
from ..plans.materialize import materialize
from .blocks import NULL_ID, packed, unpacked
from .common import arrow_of, importable, small_slices, two_columns

# fixed values: bytes of terms; the complement over code points of the ranges 00-2F, 3A-40, 5B-60 and 7B-7F
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
STEP = 1 << 20
BATCH_TERMS, BATCH_ITEMS = 1 << 16, 1024
BLOCK_DOCS, BLOCK_ENTRIES, LEAF_DOCS = 8192, 1 << 20, 48
CENTROID_NUMBERS = 1 << 23
SALTS = 32

ASKS = "ask bigint, item bigint, term binary, n bigint"
BLOCKS = "with_terms bigint, all_terms bigint, ids binary, totals binary, ends binary, dims binary, counts binary"
FOUND = "ask bigint, doc bigint, score bigint, part int"


def term_lists(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, about a megabyte of it at a time."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + STEP)
        end = gap.start() if gap else len(data)
        yield TERM.findall(data[at:end].lower())
        at = end


def asked_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``ask, item, term, n``: the terms of every item with their occurrences; ``ask`` numbers the rows."""
    target = arrow_of(ASKS)
    rows = two_columns(items, key, text).withColumn("ask", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 64):
                out = []
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for item, data, ask in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                    n = Counter()
                    for terms in term_lists(data or b""):
                        n.update(terms)
                    out += [(ask, item, term, count) for term, count in n.items()]
                columns = list(zip(*out)) or [()] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return materialize(rows.mapInArrow(run, ASKS), "asks")


def batched(asks: DataFrame) -> tuple[DataFrame, int]:
    """Deal the items to batches of at most ``BATCH_TERMS`` entries and ``BATCH_ITEMS`` items, or a single item."""
    sizes = asks.groupBy("ask").agg(F.count("*").alias("n"))
    n, terms = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    count = max(1, -(-terms * 2 // BATCH_TERMS), -(-n * 2 // BATCH_ITEMS)) if n else 0
    if count == 1:
        return asks.withColumn("batch", F.lit(0)), 1
    while count:
        dealt = sizes.withColumn("batch", F.pmod(F.xxhash64("ask"), F.lit(count)))
        held = dealt.groupBy("batch").agg(F.sum("n").alias("terms"), F.count("*").alias("items"))
        over = (F.col("items") > 1) & ((F.col("terms") > BATCH_TERMS) | (F.col("items") > BATCH_ITEMS))
        if held.where(over).isEmpty():
            break
        count *= 2
    return asks.withColumn("batch", F.pmod(F.xxhash64("ask"), F.lit(max(count, 1)))), count


@dataclass
class Query:
    ask: int
    dims: np.ndarray
    counts: np.ndarray


def document_blocks(docs: DataFrame, key: str, text: str, dims: dict[bytes, int]) -> DataFrame:
    """Write blocks of documents: their numbers of terms and their entries for the terms in ``dims``.

    Documents without such a term are only counted, in ``with_terms`` and ``all_terms``.
    """
    target = arrow_of(BLOCKS)
    known = docs.sparkSession.sparkContext.broadcast(dims)  # at most BATCH_TERMS terms, or those of one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        with_terms = all_terms = 0
        ids, totals, ends, places, counts = [], [], [], [], []

        def block() -> pa.RecordBatch:
            arrays = (ids, np.int64), (totals, np.int64), (ends, np.int64), (places, np.int32), (counts, np.int64)
            values = [with_terms, all_terms, *(packed(np.array(x, kind)) for x, kind in arrays)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

        for batch in batches:
            for part in small_slices(batch):
                for doc, data in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                    n, found = 0, Counter()
                    for terms in term_lists(data.as_py() or b""):
                        n += len(terms)
                        found.update(map(get, terms))
                    found.pop(None, None)
                    with_terms, all_terms = with_terms + (n > 0), all_terms + n
                    if not found:
                        continue
                    ids.append(NULL_ID if doc is None else doc)
                    totals.append(n)
                    places.extend(found.keys())
                    counts.extend(found.values())
                    ends.append(len(places))
                    if len(ids) >= BLOCK_DOCS or len(places) >= BLOCK_ENTRIES:
                        yield block()
                        with_terms = all_terms = 0
                        ids, totals, ends, places, counts = [], [], [], [], []
        if with_terms or ids:
            yield block()

    return materialize(two_columns(docs, key, text).mapInArrow(run, BLOCKS), "term-blocks")


def document_counts(blocks: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term occurs; at most one row per term reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for dims in batch.column(0):
                total += np.bincount(unpacked(dims.as_py(), np.int32), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["dim", "n"])

    rows = blocks.select("dims").mapInArrow(run, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[rows.column("dim").to_numpy()] = rows.column("n").to_numpy()
    return out


class BallTree:
    """A binary tree of balls over sparse vectors, given as entries (document by document) that end at ``ends``.

    ``nodes`` hold ``(first, last, left, right)`` over the documents in the tree's order, ``order``; leaves have
    left = -1. ``centroids`` has a column per node, ``radii`` are never too small.
    """

    def __init__(self, dims: np.ndarray, values: np.ndarray, ends: np.ndarray, width: int, leaf: int = LEAF_DOCS):
        n = len(ends)
        self.width = width
        self.starts, self.sizes = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        self.dims, self.values = dims, values
        self.norms = np.add.reduceat(values * values, self.starts) if n else np.zeros(0)
        self.leaf = max(leaf, -(-n * 2 * width // CENTROID_NUMBERS))  # bounds the numbers in all centroids
        self.order = np.arange(n)
        self.nodes: list[list[int]] = []
        centroids: list[np.ndarray] = []
        radii: list[float] = []
        waiting = [(0, n, -1, 0)] if n else []
        while waiting:
            first, last, parent, side = waiting.pop()
            number = len(self.nodes)
            self.nodes.append([first, last, -1, -1])
            if parent >= 0:
                self.nodes[parent][2 + side] = number
            docs = self.order[first:last]
            at = self.entries(docs)
            cut = np.concatenate([[0], np.cumsum(self.sizes[docs])[:-1]])
            place, value = self.dims[at], self.values[at]
            centroid = np.bincount(place, value, width) / (last - first)
            squared = centroid @ centroid
            near = self.norms[docs] - 2 * np.add.reduceat(value * centroid[place], cut) + squared
            slack = 1e-10 * (self.norms[docs] + squared)  # what rounding may hide
            radii.append(math.sqrt(max(0.0, float((near + slack).max())) + float(slack.max())))
            centroids.append(centroid)
            if last - first <= self.leaf or (near <= 2 * slack).all():
                continue
            line = self.dense(docs[near.argmax()])
            far = self.norms[docs] - 2 * np.add.reduceat(value * line[place], cut)
            line -= self.dense(docs[far.argmax()])
            along = np.add.reduceat(value * line[place], cut)
            middle = (last - first) // 2
            self.order[first:last] = docs[np.argpartition(along, middle)]
            waiting += [(first, first + middle, number, 0), (first + middle, last, number, 1)]
        self.centroids = np.array(centroids).T if centroids else np.zeros((width, 0))
        self.radii = np.array(radii)
        self.lengths = np.sqrt((self.centroids**2).sum(0))

    def entries(self, docs: np.ndarray) -> np.ndarray:
        """Numbers of all entries of some documents, document by document."""
        sizes = self.sizes[docs]
        shift = np.repeat(self.starts[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return shift + np.arange(len(shift))

    def dense(self, doc: int) -> np.ndarray:
        own = slice(self.starts[doc], self.starts[doc] + self.sizes[doc])
        return np.bincount(self.dims[own], self.values[own], self.width)

    def bounds(self, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
        """No member of a node has a greater inner product with the query than this."""
        length = math.sqrt(float(values @ values))
        reach = values @ self.centroids[dims] + length * self.radii
        return reach + 1e-9 * length * (self.lengths + self.radii) + 1.0


class Searcher:
    """Best-first search of all queries of a batch through the blocks that a task gets."""

    def __init__(self, queries: list[Query], weights: np.ndarray, n: int, total: int, k: int, leaf: int = LEAF_DOCS):
        self.queries, self.weights, self.n, self.total, self.k, self.leaf = queries, weights, n, total, k, leaf
        self.root = np.sqrt(weights.astype(np.float64))
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]
        self.dense = np.zeros(len(weights), np.int64)

    def add(self, ids: np.ndarray, totals: np.ndarray, ends: np.ndarray, dims: np.ndarray, tf: np.ndarray) -> None:
        m = 100 - 25 + (25 * totals * self.n) // self.total
        exact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(ends, prepend=0)))
        tree = BallTree(dims, exact * self.root[dims], ends, len(self.weights), self.leaf)
        at = tree.entries(tree.order)
        sizes = tree.sizes[tree.order]
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.ids, self.tree, self.entry_at = ids[tree.order], tree, first
        self.place, self.exact = dims[at], exact[at]
        for i, query in enumerate(self.queries):
            self.best[i] = self.search(query, self.best[i])

    def search(self, query: Query, best: list[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
        bounds = self.tree.bounds(query.dims, query.counts * self.root[query.dims]).tolist()
        self.dense[query.dims] = query.counts * self.weights[query.dims]
        least = -best[-1][0] if len(best) == self.k else 1
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            _, number = heapq.heappop(heap)
            first, last, left, right = self.tree.nodes[number]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            own = slice(self.entry_at[first], self.entry_at[last])
            cuts = self.entry_at[first:last] - self.entry_at[first]
            scores = np.add.reduceat(self.dense[self.place[own]] * self.exact[own], cuts)
            some = np.flatnonzero(scores >= least)
            if len(some):
                ids = self.ids[first:last][some].tolist()
                new = ((-s, d == NULL_ID, d) for s, d in zip(scores[some].tolist(), ids))
                best = heapq.nsmallest(self.k, [*best, *new])
                least = -best[-1][0] if len(best) == self.k else 1
        self.dense[query.dims] = 0
        return best


def search_blocks(blocks: DataFrame, queries: list[Query], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """``ask, doc, score, part``: the k best of each query among the blocks of every task."""
    target = arrow_of(FOUND)
    shared = blocks.sparkSession.sparkContext.broadcast((queries, weights))  # one batch
    kinds = np.int64, np.int64, np.int64, np.int32, np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        some, each = shared.value
        searcher = Searcher(some, each, n, total, k)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                arrays = [unpacked(x.as_py(), kind) for x, kind in zip(row, kinds)]
                if len(arrays[0]):
                    searcher.add(*arrays)
        part = TaskContext.get().partitionId() % SALTS
        rows = [
            (query.ask, None if no_id else doc, -score, part)
            for query, best in zip(some, searcher.best) for score, no_id, doc in best
        ]
        columns = list(zip(*rows)) or [()] * len(target)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return blocks.select("ids", "totals", "ends", "dims", "counts").mapInArrow(run, FOUND)


def lexical_top_k(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_key, rank, key, score``: the ``k`` best documents of every item, by score and then the smaller id.

    Starts jobs that write the items' terms and, per batch of items, the documents' entries for them.
    """
    spark = docs.sparkSession
    importable(spark)
    asks, count = batched(asked_terms(items, item_key, item_text))
    found = []
    for batch in range(count):
        rows = asks.where(F.col("batch") == batch).select("ask", "term", "n").toArrow()
        terms = sorted(set(rows.column("term").to_pylist()))
        dims = {term: i for i, term in enumerate(terms)}
        own: dict[int, dict[int, int]] = {}
        for ask, term, n in zip(*(rows.column(i).to_pylist() for i in range(3))):
            own.setdefault(ask, {})[dims[term]] = n
        queries = [
            Query(ask, np.array(sorted(x), np.int64), np.array([x[d] for d in sorted(x)], np.int64))
            for ask, x in sorted(own.items())
        ]
        blocks = document_blocks(docs, key, text, dims)
        n, total = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("with_terms", "all_terms"))).first()
        df = document_counts(blocks, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found.append(search_blocks(blocks, queries, weights, n, total, k))
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    ranked = spark.createDataFrame([], FOUND)
    for rows in found:
        ranked = ranked.unionAll(rows)
    ranked = first_per_group(ranked, ["ask", "part"], order, k).drop("_nth")
    ranked = first_per_group(ranked, ["ask"], order, k)
    names = asks.select("ask", "item").distinct()
    return ranked.join(names, "ask").select(
        F.col("item").alias(item_key), F.col("_nth").cast("int").alias("rank"), F.col("doc").alias(key), "score"
    )
