"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for every bit a binary n-gram classifier tells the languages with a 1
from those with a 0. A text's margins are decoded by loss: the language whose codeword gives the least summed
logistic loss wins, and a text whose two best codewords are nearly as good as each other is flagged.

The classifiers are log-odds of hashed byte n-grams inside words, learnt from at most ``rows_per_language``
different labelled rows per language (a documented bound on the sample; the smallest hashes of id and text are
taken, a row repeated whole is learnt as often as it occurs). Counting runs on Spark; the model is languages x 2**16
numbers, whatever the size of the corpus. More than ``MOST_LANGUAGES`` different labels are an error.

Null texts, empty texts and texts without a letter are ``und`` with score 0. With no labelled row, every text is
``und``; with one language, every text with a letter gets it. Rows are independent; repeated rows and repeated or
null ids each give a row, and each text is learnt under its own row's label. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import packed, unpacked
from .common import WordCache, arrow_of, importable, small_slices, text_rows, two_columns

UNDETERMINED = "und"
BUCKET_BITS = 16
NGRAMS = (1, 2, 3, 4, 5)
LETTER = re.compile(r"[^\W\d_]")
MOST_LANGUAGES = 256
CACHED_WORDS, LONG_WORD = 150_000, 64  # words of more characters are never cached, so a cache holds some 30 MB
_STEP = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of ' word ' for each word: ``(bucket, word number)``, all lengths together."""
    parts = [f" {w} ".encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.repeat(np.cumsum(sizes), sizes)
    return _buckets(b"".join(parts), np.repeat(np.arange(len(parts)), sizes), end, len(end))


def _buckets(data: bytes, owner: np.ndarray, end: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners of the n-grams that start in the first ``starts`` bytes and end by ``end`` of that place."""
    units = np.frombuffer(data, np.uint8).astype(np.uint64)
    places = np.arange(len(units))
    buckets, owners = [], []
    code = np.zeros(len(units), np.uint64)
    for n in NGRAMS:
        code = code[: len(units) - n + 1] * np.uint64(256) + units[n - 1 :]
        inside = (places[: len(code)] + n <= end[: len(code)]) & (places[: len(code)] < starts)
        mixed = (code[inside] + np.uint64((n * int(_MIX)) % 2**64)) * _MIX
        buckets.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[: len(code)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def long_word_buckets(word: str) -> Iterator[np.ndarray]:
    """The same buckets of one word of any length, some places at a time."""
    data = f" {word} ".encode("utf-8", "replace")
    for at in range(0, len(data), _STEP):
        piece = data[at : at + _STEP + max(NGRAMS) - 1]
        yield _buckets(piece, np.zeros(len(piece), np.int64), np.full(len(piece), len(piece)), _STEP)[0]


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1, one per language: the exhaustive code for few languages, else far-apart random bits."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 6:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(languages - 1)] for c in range(2 ** (languages - 1) - 1)]
        return np.array(columns, float).T
    width = 8 * int(np.ceil(np.log2(languages)))
    draws = (np.random.default_rng(seed).choice([-1.0, 1.0], (languages, width)) for seed in range(50))
    usable = [x for x in draws if (np.abs(x.sum(0)) < languages).all()]
    return max(usable, key=lambda x: (width - (x @ x.T)[np.triu_indices(languages, 1)]).min())


@dataclass
class Model:
    """Codewords and, per n-gram bucket, the log-odds of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: float = 20.0
    ambiguous_below: float = 0.1
    words: WordCache = field(default_factory=lambda: WordCache(CACHED_WORDS), repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"words": WordCache(CACHED_WORDS), "table": None}

    def learn(self, words: list[str]) -> None:
        """Put summed log-odds and n-gram counts of new words in the table."""
        if self.table is None or len(self.words) > self.words.limit:
            self.words.clear()
            self.table = np.zeros((1024, self.weights.shape[1] + 1), np.float32)
        for start in range(0, len(words), 5000):
            some = words[start : start + 5000]
            bucket, owner = ngram_buckets(some)
            order = np.argsort(owner, kind="stable")
            owner, first = np.unique(owner[order], return_index=True)
            values = np.concatenate([self.weights[bucket[order]], np.ones((len(order), 1), np.float32)], 1)
            used = len(self.words)
            while used + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[used : used + len(some)] = np.add.reduceat(values, first, axis=0)
            self.words.update(zip(some, range(used, used + len(some))))

    def margins(self, texts: list[str]) -> np.ndarray:
        split, long = [], []
        for text in texts:
            words = text.lower().split()
            long.append([w for w in words if len(w) > LONG_WORD])
            split.append([w for w in words if len(w) <= LONG_WORD] if long[-1] else words)
        missing = {w for words in split for w in set(words) if w not in self.words}
        if missing or self.table is None:
            self.learn(sorted(missing))
            if len(self.words) <= len(missing):  # it was emptied
                self.learn([w for w in {w for words in split for w in words} if w not in self.words])
        out = np.zeros((len(texts), self.weights.shape[1]))
        for i, (words, others) in enumerate(zip(split, long)):
            total = np.zeros(self.weights.shape[1] + 1)
            if words:
                at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
                for start in range(0, len(at), 100_000):
                    total += self.table[at[start : start + 100_000]].sum(0, dtype=np.float64)
            for word in others:
                for bucket in long_word_buckets(word):
                    total[:-1] += self.weights[bucket].sum(0, dtype=np.float64)
                    total[-1] += len(bucket)
            out[i] = total[:-1] / max(total[-1], 1)
        return out

    def __call__(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        lettered = [bool(LETTER.search(x)) for x in texts]
        if not self.languages or not texts:
            return [(UNDETERMINED, 0.0, False)] * len(texts)
        margins = self.margins([x if ok else "" for x, ok in zip(texts, lettered)])
        loss = np.logaddexp(0, -self.scale * margins[:, None, :] * self.code[None]).sum(2)
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        best, ranked = chance.argmax(1), np.sort(chance, 1)
        second = ranked[:, -2] if chance.shape[1] > 1 else np.zeros(len(texts))
        return [
            (self.languages[b], float(top), bool(top - next_ < self.ambiguous_below)) if ok else (UNDETERMINED, 0.0, False)
            for b, top, next_, ok in zip(best, ranked[:, -1], second, lettered)
        ]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of a task: how often each n-gram bucket occurs."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").lower().split()
            total = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            short = [w for w in words if len(w) <= LONG_WORD]
            for start in range(0, len(short), 5000):
                total += np.bincount(ngram_buckets(short[start : start + 5000])[0], minlength=len(total))
            for word in words if len(short) < len(words) else ():
                for bucket in long_word_buckets(word) if len(word) > LONG_WORD else ():
                    total += np.bincount(bucket, minlength=len(total))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([packed(x) for x in counts.values()], pa.binary())], names=["lang", "counts"]
    )


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed counts of one language; only tasks that hold rows of the sample send any."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for x in batch.column(batch.schema.names.index("counts")):
            total += unpacked(x.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([packed(total)])], names=["lang", "counts"])


def fit(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 1000
) -> Model:
    """Learn from the rows of ``df`` whose language is not null. Starts jobs."""
    importable(df.sparkSession)
    labelled = df.where(F.col(lang).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).withColumn("mark", F.xxhash64("key", "text"))
    known = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if known > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in column {lang}")
    place = Window.partitionBy("lang").orderBy("mark")
    nth = labelled.select("lang", "mark").withColumn("nth", F.row_number().over(place))
    chosen = nth.where(F.col("nth") <= rows_per_language).select("lang", "mark").distinct()
    # at most rows_per_language rows for each of at most MOST_LANGUAGES languages
    sample = labelled.join(F.broadcast(chosen), ["lang", "mark"])
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, counts binary")
    found = counts.groupBy("lang").applyInArrow(_added, "lang string, counts binary").collect()  # one row per language
    rows = {name: unpacked(x, np.int64) for name, x in found}
    languages = sorted(rows)
    code = codewords(len(languages))
    totals = np.array([rows[x] for x in languages], float).reshape(len(languages), 1 << BUCKET_BITS)
    rates = totals / np.maximum(totals.sum(1, keepdims=True), 1)  # every language weighs the same
    floor = 1e-6
    weights = np.zeros((1 << BUCKET_BITS, code.shape[1]), np.float32)
    if len(languages) > 1:
        for bit in range(code.shape[1]):
            ones, zeros = rates[code[:, bit] > 0].mean(0), rates[code[:, bit] < 0].mean(0)
            weights[:, bit] = np.log(ones + floor) - np.log(zeros + floor)
    return Model(languages, code, weights)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, ambiguous`` per row, from the text alone. The model is sent to each executor once."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return text_rows(df, key, text, lambda x: shared.value(x), "lang_pred string, score double, ambiguous boolean")


def in_known_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose language is found and not ambiguous.

    Rows are streamed a few at a time, so a task holds one small slice of texts beside its batch.
    """
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = df.columns
    # the text comes first once more, as a string, under a name of its own; the others go by place
    plain = df.toDF(*(f"c{i}" for i in range(len(columns))))
    rows = plain.select(F.col(f"c{columns.index(text)}").cast("string").alias("text"), *plain.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, 256):
                found = shared.value([x or "" for x in part.column(0).to_pylist()])
                keep = pa.array([name != UNDETERMINED and not ambiguous for name, _, ambiguous in found], pa.bool_())
                yield pa.RecordBatch.from_arrays(part.columns[1:], names=part.schema.names[1:]).filter(keep)

    return rows.mapInArrow(run, plain.schema).toDF(*columns)
