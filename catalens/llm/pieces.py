"""SentencePiece encoding and decoding with batched numpy work on words of equal length.

Words of one length stand in a matrix of characters and advance together: prefix sums give the hash of any
substring of every word, the hashes probe the sorted keys of the pieces, and a vectorised maximum picks for each
word. For a unigram model this is Viterbi: place by place, the best score of the pieces that end there, with
backpointers. For a BPE model the best-scoring path is not what the model means (its scores are merge ranks), and
Viterbi would give other ids; there the same matrix advances merge by merge: the maximum over each word's adjacent
pairs is merged, leftmost on ties, until no pair is a piece.

Null text is empty and gives no ids; so does an empty text. A text holding characters outside the vocabulary falls
back to byte pieces if the model has them, else to the unknown id. Rows are independent.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordCache, arrow_of, small_slices, two_columns
from .hashing import mix, powers

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
COLUMNS = "ids array<int>, n_ids bigint, decoded_sha256 string, round_trip boolean"


def fields(data: bytes) -> dict[int, list]:
    """Fields of a protobuf message: numbers, 4-byte strings or byte strings, by field number."""
    out, at = defaultdict(list), 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            out[tag >> 3].append(number())
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            out[tag >> 3].append(data[at : at + size])
            at += size
    return out


def _hashes(chars: np.ndarray):
    """Function from (row, start, end) to the hash of that substring of the rows of a character matrix."""
    up, down = powers(chars.shape[1] + 1)
    prefix = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * up[:-1], axis=1, out=prefix[:, 1:])
    return lambda row, start, end: mix((prefix[row, end] - prefix[row, start]) * down[start])


def matrix(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


class Pieces:
    """One SentencePiece model."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = fields(file.read())
        trainer, normal = fields(model[2][0] if model[2] else b""), fields(model[3][0] if model[3] else b"")
        self.kind = (trainer[3] or [UNIGRAM])[0]
        self.byte_fallback = bool((trainer[35] or [0])[0])
        self.dummy_prefix = bool((normal[3] or [1])[0])
        self.trims = bool((normal[4] or [1])[0])
        if self.kind not in (UNIGRAM, BPE) or any(normal[2]) or not (normal[5] or [1])[0]:
            raise ValueError("only unigram and BPE models with the identity normaliser are covered")
        rows = [fields(x) for x in model[1]]
        self.text = [x[1][0].decode("utf-8") for x in rows]
        self.type = [(x[3] or [NORMAL])[0] for x in rows]
        if {USER, UNUSED} & set(self.type):
            raise ValueError("models with user-defined or unused pieces are not covered")
        scores = [np.frombuffer(x[2][0], "<f4")[0] if x[2] else 0.0 for x in rows]
        plain = [i for i, t in enumerate(self.type) if t == NORMAL]
        self.unknown = next((i for i, t in enumerate(self.type) if t == UNKNOWN), 0)
        self.byte = {int(self.text[i][1:-1], 16): i for i, t in enumerate(self.type) if t == BYTE}
        self.longest = max((len(self.text[i]) for i in plain), default=1)
        by_length = defaultdict(list)
        for i in plain:
            by_length[len(self.text[i])].append(i)
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size, some in by_length.items():
            chars = matrix([self.text[i] for i in some])
            rows_ = np.arange(len(some))
            keys.append(_hashes(chars)(rows_, np.zeros(len(some), np.int64), np.full(len(some), size)))
            ids.append(np.array(some))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], ids[order]
        self.scores = np.array([scores[i] for i in self.ids], np.float32)  # summed as the library does
        self.unknown_score = np.float32(min((scores[i] for i in plain), default=0.0) - 10)
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.whole = any(inner.search(self.text[i]) for i in plain)  # some piece holds a word border
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache = WordCache(600_000)
        shown = [
            bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN
            else p.replace(SPACE, " ").encode()
            for p, t in zip(self.text, self.type)
        ]
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.byte_ends = np.cumsum([len(x) for x in shown])
        self.byte_sizes = np.array([len(x) for x in shown])

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted keys, -1 if there is none."""
        if not len(self.keys):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def cut(self, words: list[str]) -> list[list[int]]:
        """Ends of the pieces of words of one length."""
        chars = matrix(words)
        return (self._merge if self.kind == BPE else self._viterbi)(chars.shape, _hashes(chars))

    def _viterbi(self, shape: tuple[int, int], hashes) -> list[list[int]]:
        n, size = shape
        best = np.full((n, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, size + 1):
            starts = np.arange(max(0, end - self.longest), end)
            at = self.probe(hashes(rows[:, None], starts[None, :], np.full((1, 1), end)))
            score = np.where(at >= 0, self.scores[at] if len(self.scores) else 0, -np.inf).astype(np.float32)
            score[:, -1] = np.where(at[:, -1] >= 0, score[:, -1], self.unknown_score)
            total = best[:, starts] + score
            choice = total.argmax(1)
            best[:, end], back[:, end] = total[rows, choice], starts[choice]
        out = []
        for row in back.tolist():
            ends, at = [], size
            while at:
                ends.append(at)
                at = row[at]
            out.append(ends[::-1])
        return out

    def _merge(self, shape: tuple[int, int], hashes) -> list[list[int]]:
        n, size = shape
        after = np.tile(np.arange(1, size + 2), (n, 1))  # where the symbol that starts here ends
        before = np.tile(np.arange(-1, size), (n, 1))  # where the symbol that ends here starts

        def score(row, start, end):
            at = self.probe(hashes(row, start, end))
            return np.where(at >= 0, self.scores[at] if len(self.scores) else 0, -np.inf)

        pair = np.full((n, size + 1), -np.inf)
        if size > 1:
            places = np.arange(size - 1)
            pair[:, : size - 1] = score(np.arange(n)[:, None], places[None, :], places[None, :] + 2)
        live = np.arange(n)
        while len(live):
            left = pair[live].argmax(1)
            going = pair[live, left] > -np.inf
            live, left = live[going], left[going]
            if not len(live):
                break
            middle = after[live, left]
            end = after[live, middle]
            after[live, left] = end
            before[live, end] = left
            pair[live, middle] = -np.inf
            inner = end < size
            right = np.where(inner, after[live, np.minimum(end, size)], size)
            pair[live, left] = np.where(inner, score(live, left, np.minimum(right, size)), -np.inf)
            outer = before[live, left]
            some = outer >= 0
            pair[live[some], outer[some]] = score(live[some], outer[some], end[some])
        out = []
        for row in after.tolist():
            ends, at = [], 0
            while at < size:
                at = row[at]
                ends.append(at)
            out.append(ends)
        return out

    def learn(self, words: list[str]) -> None:
        by_length = defaultdict(list)
        for word in words:
            by_length[len(word)].append(word)
        for size, some in by_length.items():
            step = max(1, (1 << 18) // (size * (self.longest if self.kind == UNIGRAM else 1)))
            for start in range(0, len(some), step):
                batch = some[start : start + step]
                cuts = self.cut(batch)
                counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
                ends = np.fromiter(chain.from_iterable(cuts), np.int64, int(counts.sum()))
                row = np.repeat(np.arange(len(batch)), counts)
                begins = np.concatenate([[0], ends[:-1]])
                begins[np.cumsum(counts) - counts] = 0
                at = self.probe(_hashes(matrix(batch))(row, begins, ends))
                ids = np.where(at >= 0, self.ids[at] if len(self.ids) else 0, -1).astype("<i4")
                raw, missing = ids.tobytes(), set(row[ids < 0].tolist())
                to = np.cumsum(counts).tolist()
                for i, word in enumerate(batch):
                    first, last = to[i] - int(counts[i]), to[i]
                    self.cache[word] = (
                        raw[4 * first : 4 * last] if i not in missing
                        else self._with_unknown(word, begins[first:last], ends[first:last], ids[first:last])
                    )

    def _with_unknown(self, word: str, begins, ends, ids) -> bytes:
        out, open_unknown = [], False
        for b, e, i in zip(begins.tolist(), ends.tolist(), ids.tolist()):
            unknown = i < 0 and not (self.byte_fallback and self.byte)
            if i >= 0:
                out.append(i)
            elif not unknown:
                out += [self.byte[x] for x in word[b:e].encode("utf-8", "replace")]
            elif not open_unknown:
                out.append(self.unknown)
            open_unknown = unknown
        return np.array(out, "<i4").tobytes()

    def parts(self, text: str) -> list[str]:
        if self.trims:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return [text] if self.whole else self.words.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self.cache.make_room()
        parts = [self.parts(x) for x in texts]
        self.learn(sorted(x for x in set(chain.from_iterable(parts)) if x not in self.cache))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, x)), "<i4") for x in parts]

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.byte_sizes[ids]
        total = int(sizes.sum())
        place = np.arange(total) + np.repeat(self.byte_ends[ids] - np.cumsum(sizes), sizes)
        text = self.bytes[place].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_and_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, n_ids, decoded_sha256, round_trip``: the ids of each text, and whether decoding gives it back."""
    schema = f"`{key}` bigint, {COLUMNS}"
    target = arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in small_slices(batch, 128):
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = model.encode(texts)
                decoded = [model.decode(x) for x in ids]
                sizes = [len(x) for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                values = pa.array(np.concatenate([np.zeros(0, "<i4"), *ids]), pa.int32())
                columns = [
                    part.column(0), pa.ListArray.from_arrays(offsets, values, type=target.field(1).type),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded], pa.string()),
                    pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return two_columns(df, key, text).mapInArrow(run, schema)
