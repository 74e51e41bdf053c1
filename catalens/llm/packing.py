"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents become token pieces (only a document longer than a sequence is cut); full pieces are sequences of
their own. The other pieces go to groups of about ``group_rows`` by a hash, so that a task holds a bounded
number of lengths (never tokens) whatever the size of the corpus, and each group is packed by itself: best
fit, longest first, then a local search between underfull bins. It takes the emptiest bin and moves a piece, or
exchanges one piece for one or one for two, whenever that fills another bin further; each step increases the
sum of squared fills, and a bin that runs empty is saved. The search ends when no step is left, or when the
number of bins has reached its lower bound. What a group wastes is bounded by about one bin.

Null text counts as empty: one piece that holds only the closing id. Repeated rows and repeated or null ids are
packed as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import RecentWords, arrow_of, small_slices, two_columns
from .token_counts import byte_symbols

CLOSE = (1).to_bytes(4, "little")
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"

#: What a tokenizer file says if its words are cut here: how it normalises, and how it splits.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of ASCII and Latin-1 letters only: NFC leaves them, and each letter has one lower-case letter.
PLAIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]+")
#: The same split for lower-case words of that kind.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Ids:
    """Token ids of texts as little-endian bytes, by the library for a tokenizer whose words end at white space.

    A new word goes to the library. Where the file's rules are the known ones, plain words are lower-cased and split
    here, so that only pretokens not seen lately go to the library's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize, self.symbols = self.library.model.tokenize, byte_symbols()
        self.words, self.pretokens = RecentWords(self.of_word, 150_000), RecentWords(self.of_pretoken, 200_000)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.known = (
            spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS}
            and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": split}
            and not any(x["normalized"] or x["content"].isalpha() for x in spec["added_tokens"])
        )
        # only what white space is to both Python and the library may part words
        self.odd = sorted({chr(c) for c in range(0x3001) if chr(c).isspace()} - set(" \t\n\r"))

    def of_text(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_pretoken(self, pretoken: str) -> bytes:
        if not (pretoken.isascii() and pretoken.isprintable()):  # else its bytes are their own symbols
            pretoken = "".join(map(self.symbols.__getitem__, pretoken.encode("utf-8")))
        ids = [x.id for x in self.tokenize(pretoken)]
        return pack("<%dI" % len(ids), *ids)

    def of_word(self, word: str) -> bytes:
        if not (self.known and (word.isascii() or PLAIN.fullmatch(word))):
            return self.of_text(word)
        if word.isalpha():
            return self.pretokens[word.lower()]
        if any(map(word.__contains__, self.special)):
            return self.of_text(word)
        return b"".join(map(self.pretokens.__getitem__, PRETOKEN.findall(word.lower())))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if any(map(text.__contains__, self.odd)):
                yield self.of_text(text)
            else:
                yield b"".join(map(self.words.__getitem__, text.split()))

    def forget(self) -> None:
        self.words.forget()
        self.pretokens.forget()


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    return Ids(path)


def token_pieces(df: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, piece, start, length, ids_crc32``: the documents' ids, each with id 1 at its end, cut at ``capacity``."""
    schema = f"key bigint, {PIECES}"
    target = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = ids_of(path), 4 * capacity
        try:
            for batch in batches:
                for part in small_slices(batch, 128):
                    rows = []
                    for doc, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()])):
                        ids += CLOSE
                        for i, at in enumerate(range(0, len(ids), step)):
                            cut = ids[at : at + step]
                            rows.append((doc, i, at // 4, len(cut) // 4, zlib.crc32(cut)))
                    columns = list(zip(*rows)) or [()] * len(target)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)
        finally:
            encode.forget()  # an idle worker holds no words while other stages run

    return two_columns(df, key, text).mapInArrow(run, schema)


class Bins:
    """Bins of one group. ``items`` holds lengths; the work is on lists of item numbers per bin."""

    def __init__(self, items: np.ndarray, capacity: int):
        self.size = [int(x) for x in items]
        self.capacity = capacity
        self.least = -(-sum(self.size) // capacity)
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        by_gap: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        gaps = 0  # bit g is set when some bin has g free places
        for item in sorted(range(len(self.size)), key=lambda i: (-self.size[i], i)):
            size = self.size[item]
            fitting = gaps >> size
            if fitting:
                gap = size + (fitting & -fitting).bit_length() - 1
                b = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps ^= 1 << gap
                self.bins[b].append(item)
                self.fill[b] += size
            else:
                b = len(self.bins)
                self.bins.append([item])
                self.fill.append(size)
            gap = self.capacity - self.fill[b]
            by_gap[gap].append(b)
            gaps |= 1 << gap

    def step(self, giver: int, taker: int) -> bool:
        """The move or exchange from ``giver`` to ``taker`` that fills ``taker`` most, if there is one."""
        gap = self.capacity - self.fill[taker]
        if not gap:
            return False
        size, give, take = self.size, self.bins[giver], self.bins[taker]
        best, plan = 0, None
        for x in give:
            if best < size[x] <= gap:
                best, plan = size[x], ((x,), ())
        if best < gap:
            gives = np.array([size[x] for x in give])
            takes = np.array([size[x] for x in take])
            singles = gives[:, None] - takes[None, :]
            i, j = np.triu_indices(len(give), 1)
            doubles = (gives[i] + gives[j])[:, None] - takes[None, :]
            k, m = np.triu_indices(len(take), 1)
            backs = gives[:, None] - (takes[k] + takes[m])[None, :]
            for gain, outs, ins in (
                (singles, lambda a: (give[a],), lambda b: (take[b],)),
                (doubles, lambda a: (give[i[a]], give[j[a]]), lambda b: (take[b],)),
                (backs, lambda a: (give[a],), lambda b: (take[k[b]], take[m[b]])),
            ):
                if gain.size:
                    allowed = np.where(gain <= gap, gain, 0)
                    at = int(allowed.argmax())
                    if allowed.flat[at] > best:
                        best = int(allowed.flat[at])
                        a, b = divmod(at, gain.shape[1])
                        plan = outs(a), ins(b)
        if plan is None:
            return False
        out, back = plan
        self.bins[giver] = [x for x in give if x not in out] + list(back)
        self.bins[taker] = [x for x in take if x not in back] + list(out)
        self.fill[giver] -= best
        self.fill[taker] += best
        return True

    def local_search(self, effort: int = 2) -> None:
        """Empty the emptiest bins into the others.

        Every step moves fill from a bin to a fuller one, so the sum of squares grows and the search ends; at
        most ``effort`` pairs of bins per item are tried.
        """
        tries = effort * len(self.size)
        open_bins = sorted((b for b in range(len(self.bins)) if self.fill[b] < self.capacity), key=self.fill.__getitem__)
        used = len(self.bins)
        while used > self.least and len(open_bins) > 1 and tries > 0:
            giver = open_bins[0]
            moved = False
            for taker in reversed(open_bins[1:]):
                tries -= 1
                while self.bins[giver] and self.fill[taker] >= self.fill[giver] and self.step(giver, taker):
                    moved = True
                if not self.bins[giver] or tries <= 0:
                    break
            if not self.bins[giver]:
                used -= 1
                open_bins.pop(0)
            elif not moved:
                open_bins.pop(0)  # nothing can leave it: the next emptiest is tried
            open_bins = sorted((b for b in open_bins if self.fill[b] < self.capacity), key=self.fill.__getitem__)

    def packed(self) -> Iterator[tuple[int, int, int]]:
        """``(item, bin, offset)`` of every item."""
        for b, items in enumerate(x for x in self.bins if x):
            at = 0
            for item in items:
                yield item, b, at
                at += self.size[item]


def packed_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins = Bins(group["length"].to_numpy(), capacity)
        bins.best_fit()
        bins.local_search()
        item, sequence, offset = zip(*bins.packed())
        out = group.loc[list(item)].copy()
        out["sequence_id"] = (np.int64(group["part"].iloc[0]) << 32) + np.array(sequence, np.int64)
        out["offset"] = np.array(offset, np.int64)
        return out.drop(columns="part")

    return run


def pack_pieces(pieces: DataFrame, capacity: int, group_rows: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to token pieces.

    Starts jobs: the pieces are written to the shared folder and counted.
    """
    pieces = materialize(pieces, "pieces")
    full = F.col("length") == capacity
    groups = -(-pieces.where(~full).count() // group_rows) or 1
    alone = pieces.where(full).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    part = F.pmod(F.xxhash64("key", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    schema = f"key bigint, {PIECES}, sequence_id bigint, offset bigint"
    shared = pieces.where(~full).withColumn("part", part).groupBy("part").applyInPandas(packed_group(capacity), schema)
    return alone.unionByName(shared)


def pack_documents(
    df: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text", group_rows: int = 20_000
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece of a document."""
    packed = pack_pieces(token_pieces(df, path, capacity, key, text), capacity, group_rows)
    return packed.withColumnRenamed("key", key)
