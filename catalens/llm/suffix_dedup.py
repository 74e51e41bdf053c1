"""Removal of byte strings that an earlier document already has, by hashes of windows in place of sorted suffixes.

Only the first ``length`` bytes of a suffix matter here, and a full suffix array of the corpus would be several
times its size. So no suffixes are sorted and no ranks are made: a cover sample stands for all places, and its
places are dealt to buckets by the hash of their run, where hashes of stretches and windows, sorted with their
documents, decide what is equal; bytes are not compared again. The cover is chosen by
content (the least hash in every window) instead of by place modulo a period: it keeps a difference cover's
property that two equal strings have a sampled place at the same offset, with 7 % of all places in place of 19 %
(six residues of 31 would be needed at least). See ``repeats``.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with a smaller id.
Matches never cross documents and are judged on the input. Null text is empty; a null id counts as smaller than
all others; rows with equal ids count as one document for "smaller", and each gives a row. Hashes have 64 bits:
for n distinct windows the chance that any two clash is about n*n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .blocks import Block, rest_of, text_blocks
from .common import each_row, importable
from .hashing import BYTE
from .repeats import EARLIER, find, runs_of

RUN = 24
COLUMNS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _units(row: dict):
    block = Block.of(row)
    return (lambda a, b: BYTE[block.data[a:b]]), block.ends, block.ids


def suffix_dedup(
    df: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", with_kept: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256``, on request ``kept``, and the columns named in ``carry``.

    ``kept`` is the text that remains; what is left of a character that was cut in two goes as well.
    """
    importable(df.sparkSession)
    carry = [c for c in carry if c not in (key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    start_blocks = text_blocks(df, key, text, carry=carry)
    blocks, mark = find(start_blocks, _units, length, min(RUN, length), EARLIER)
    own = f"`{key}` bigint, {COLUMNS if with_kept else COLUMNS.rpartition(',')[0]}"
    schema = StructType([*StructType.fromDDL(own), *(StructField(c, df.schema[c].dataType) for c in carry)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                block, removed = Block.of(row), mark(row)
                rows, start = [], 0
                for doc, end, (n, spans) in zip(block.id_list, block.ends.tolist(), runs_of(removed, block.ends)):
                    kept = block.data[start:end][~removed[start:end]].tobytes()
                    sha = hashlib.sha256(kept).hexdigest()
                    rows.append((doc, end - start, n, spans, sha) + ((kept.decode("utf-8", "ignore"),) * with_kept))
                    start = end
                values = [pa.array(v, f.type) for v, f in zip(zip(*rows), target)] + rest_of(row)
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, target)], schema=target)

    return blocks.mapInArrow(run, schema)
