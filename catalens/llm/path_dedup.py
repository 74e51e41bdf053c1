"""Removal of long repeated word spans by hashes of windows, after the picture of a compacted De Bruijn graph.

The graph itself is not built: there are no joins of k-mer edges, no path compaction by joins, and the words of
windows with equal hashes are not compared again. In the picture, nodes are runs of ``RUN`` words, chosen by content so that equal windows of ``length`` words contain the same node
at the same offset. An edge is a node with its stretch of windows (a run of k-mers that leads through it). Edges
of all documents meet in Spark by their node's hash: a node whose edges are all alike does not branch, so the whole
stretch is compacted into one path and is settled at once if it occurs again. At branching nodes, one copy of
each distinct edge is opened into its single windows, which are compared across the corpus; the source coordinates
of the settled windows then mark the words. See ``repeats``.

A word is removed if a window of ``length`` consecutive words that covers it also starts at any other place, in the
same document or another. Windows are judged on the input. Words are separated by space, tab, line feed, vertical
tab, form feed and carriage return. Null text has no words. Rows with equal or null ids are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, text_blocks
from .common import arrow_of, each_row, importable
from .hashing import word_hashes
from .repeats import ANYWHERE, find, runs_of

RUN = 6
COLUMNS = "n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _words(block: Block):
    hashes, starts, _ = word_hashes(block.data, block.ends)
    return hashes, np.searchsorted(starts, block.ends)


def _units(row: dict):
    block = Block.of(row)
    hashes, ends = _words(block)
    return (lambda a, b: hashes[a:b]), ends, block.ids


def path_dedup(
    df: DataFrame, length: int = 35, key: str = "doc_id", text: str = "text", with_kept: bool = True
) -> DataFrame:
    """``key, n_words, n_removed, n_spans, kept_sha256`` and, on request, ``kept`` (words joined by one space)."""
    importable(df.sparkSession)
    blocks, mark = find(text_blocks(df, key, text), _units, length, min(RUN, length), ANYWHERE)
    schema = f"`{key}` bigint, {COLUMNS if with_kept else COLUMNS.rpartition(',')[0]}"
    target = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                block, removed = Block.of(row), mark(row)
                data, ends = block.data.tobytes(), _words(block)[1]
                rows, start, at = [], 0, 0
                for doc, stop, end, (n, spans) in zip(
                    block.id_list, block.ends.tolist(), ends.tolist(), runs_of(removed, ends)
                ):
                    words = data[start:stop].split()
                    kept = b" ".join(compress(words, (~removed[at:end]).tolist()) if n else words)
                    rows.append((doc, end - at, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")))
                    start, at = stop, end
                values = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target)], schema=target)

    return blocks.mapInArrow(run, schema)
