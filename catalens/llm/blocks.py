"""Documents in blocks of a few megabytes, and questions that blocks put to each other through Spark shuffles.

A block is a row of compressed text with the ids of its documents, so a shuffle of blocks moves compressed
bytes. Blocks ask about keys (hashes): a request is one row per (block, part of the key space) that holds a
sorted array of keys; a part sees every block's request for its keys and answers with one byte per key. Keys
are made unique within a block first, so a key that a third of all documents have comes to its part once per
block. The number of parts follows the size of the corpus, and a request never has more rows than keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import arrow_of, each_row

BLOCK_BYTES = 2 << 20
PART_BYTES = 12 << 20  # of text for each part of the key space
NULL_ID = -(1 << 63)
BLOCKS = "block bigint, size bigint, ids binary, no_id binary, ends binary, data binary, rest binary"
REQUEST = "part bigint, block bigint, keys binary, more binary"
REPLY = "block bigint, part bigint, codes binary"


def packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


@dataclass
class Block:
    """Texts of some documents in ascending order of their ids (null first)."""

    ids: np.ndarray
    no_id: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(
            unpacked(row["ids"], np.int64), unpacked(row["no_id"], bool), unpacked(row["ends"], np.int64),
            unpacked(row["data"], np.uint8),
        )

    @property
    def id_list(self) -> list[int | None]:
        return [None if no else x for x, no in zip(self.ids.tolist(), self.no_id.tolist())]


def carried(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns of a table under the fixed names c0, c1, ... that blocks carry them by."""
    return [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]


def rest_of(row: dict) -> list[pa.Array]:
    """The carried columns of a block, in the order of its documents."""
    if not row["rest"]:
        return []
    with pa.ipc.open_stream(pa.BufferReader(zstandard.ZstdDecompressor().decompress(row["rest"]))) as stream:
        return list(stream.read_next_batch().columns)


def text_blocks(
    df: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES, carry: Sequence[str] = ()
) -> DataFrame:
    """Write the texts as blocks to the shared folder; a longer text is a block of its own.

    A block also holds the columns named in ``carry``, so that nothing has to be joined to the result.
    """
    target = arrow_of(BLOCKS)
    carry = list(carry)

    def rest(docs: list[tuple], kind: pa.StructType) -> bytes:
        batch = pa.RecordBatch.from_struct_array(pa.array([x[2] for x in docs], kind))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())

    def row(number: int, docs: list[tuple], kind) -> pa.RecordBatch:
        docs.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        ids = np.array([NULL_ID if x[0] is None else x[0] for x in docs], np.int64)
        ends = np.cumsum([len(x[1]) for x in docs], dtype=np.int64)
        data = np.frombuffer(b"".join(x[1] for x in docs), np.uint8)
        no_id = np.array([x[0] is None for x in docs])
        values = [number, len(data), packed(ids), packed(no_id), packed(ends), packed(data), rest(docs, kind) if carry else b""]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, docs, size, kind = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            more = batch.column(2) if carry else [None] * len(keys)
            kind = more.type if carry else None
            for doc, value, other in zip(keys, batch.column(1).cast(pa.binary()), more):
                value = value.as_py() or b""
                if docs and size + len(value) > block_bytes:
                    yield row(number, docs, kind)
                    number, docs, size = number + 1, [], 0
                docs.append((doc, value, other.as_py() if carry else None))
                size += len(value)
        if docs:
            yield row(number, docs, kind)

    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
        *([F.struct(*carried(df, carry)).alias("more")] if carry else []),
    )
    return materialize(rows.mapInArrow(run, BLOCKS), "blocks")


def part_count(blocks: DataFrame, part_bytes: int = PART_BYTES) -> int:
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(1, -(-total // part_bytes))


def parted(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins and ends in sorted 48-bit keys: ``parts + 1`` places."""
    return np.searchsorted(keys, np.array([(i << 48) // parts for i in range(parts)] + [1 << 48], np.uint64))


def six_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view("<u8")


def ask(
    blocks: DataFrame, questions: Callable[[dict], tuple[np.ndarray, Callable[[slice], bytes]]],
    answer: Callable[[list[bytes], list[bytes]], list[np.ndarray]], parts: int,
) -> DataFrame:
    """Answers of the parts as ``block, part, codes``.

    ``questions`` gives, for a row of ``blocks``, sorted 48-bit keys and what to send with a slice of them;
    ``answer`` maps the keys and extras of all requests to a part to one code array per request.
    """
    request, reply = arrow_of(REQUEST), arrow_of(REPLY)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                keys, extra = questions(row)
                at = parted(keys, parts)
                some = [i for i in range(parts) if at[i] < at[i + 1]]
                slices = [slice(at[i], at[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()),
                        pa.array([six_bytes(keys[s]) for s in slices], pa.binary()),
                        pa.array([extra(s) for s in slices], pa.binary()),
                    ],
                    schema=request,
                )

    def resolve(table: pa.Table) -> pa.Table:
        codes = answer(table.column("keys").to_pylist(), table.column("more").to_pylist())
        return pa.Table.from_arrays(
            [table.column("block"), table.column("part"), pa.array([packed(x) for x in codes], pa.binary())], schema=reply
        )

    return blocks.mapInArrow(put, REQUEST).groupBy("part").applyInArrow(resolve, REPLY)


def with_replies(blocks: DataFrame, **replies: DataFrame) -> DataFrame:
    """Join to each block the answers it got: an array of (part, codes) per name, null if it asked nothing."""
    for name, reply in replies.items():
        own = reply.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "codes"))).alias(name))
        blocks = blocks.join(own, "block", "left")
    return blocks


def codes_of(replies: list[dict] | None) -> np.ndarray:
    """The codes of a block's keys, in the order of the keys."""
    return np.concatenate([unpacked(x["codes"], np.uint8) for x in replies]) if replies else np.zeros(0, np.uint8)
