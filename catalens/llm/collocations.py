"""Phrase collocation mining: multikey quicksort of suffix pointers, cut off at a depth of four words.

A place in a text points at a suffix: its word and the up to three that follow in the same piece. Suffixes are routed
by their leading words, so all that start alike meet in one part, and each part sorts its pointers with three-way
partitions, a word at a time. The pointers that equal the pivot down to depth d are the occurrences of one phrase of
d words, so the size of an equal partition is that phrase's count. A partition that is smaller than the least count is
abandoned, with everything below it.

Before routing, suffixes are cut where no frequent phrase can go on: hashed counts of words and pairs of neighbours,
then of triples and quadruples made of frequent pairs, say which cannot reach the least count (a cell holds at least
its own phrases' count, so only infrequent ones are cut off). Tasks count equal suffixes before they send them. A pair
whose cell shows that it is very frequent is routed by all words of the suffix, so one part never gets all of it;
counts of such pairs, and of triples that start with them, are sums over parts.

Words are ``[^\\x20\\x09]+`` within pieces, which end at any of ``.,;:!?`` and line breaks (0A to 0D); A-Z are
lower-cased, other letters stay. Null text is empty, null languages are ``und``. Repeated rows count as often as they
occur. A table without candidates gives no row; other columns are ignored. Tasks tell suffixes apart by 64-bit
hashes, parts by their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grouped import first_per_group
from ..plans.materialize import materialize
from .blocks import packed, unpacked
from .common import arrow_of, importable, small_slices
from .hashing import BYTE, LOWER, Runs, mix

DEPTH = 4
CHUNK_BYTES = 4 << 20
HEAVY, HOT_CELLS = 1 << 17, 1 << 16  # pointers at a pair beyond which it is routed by all words; how many such at most
PART_BYTES, STORED_SUFFIXES = 8 << 20, 200_000  # of text for each part; entries that a task holds
LARGEST_TEXT_SLICE = 4 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True  # fixed values: what ends a piece
PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")

SUFFIXES = "part bigint, lang string, suffixes binary, depths binary, counts binary"
PHRASES = "lang string, phrase string, words int, n bigint"


def in_slices(data: bytes) -> Iterator[bytes]:
    """A text in slices of a few megabytes that end where a piece does (or at the end of the text)."""
    at = 0
    while at < len(data):
        stop = PIECE_END.search(data, at + LARGEST_TEXT_SLICE)
        end = stop.start() if stop else len(data)
        yield data[at:end]
        at = end


def cells_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def set_in(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0


class Places:
    """The words of some texts of one language: where each starts and ends, its hash, and whether the next follows it."""

    def __init__(self, texts: list[bytes], seed: np.uint64):
        self.data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        self.raw = self.data.tobytes()
        stop = BREAK[self.data]
        inside = ~(stop | BLANK[self.data])
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.words = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):  # whole words, about a megabyte at a time
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + (1 << 20), "right")))
            base = self.starts[at]
            runs = Runs(BYTE[self.data[base : self.ends[to - 1]]])
            self.words[at:to] = runs.at(self.starts[at:to] - base, self.ends[at:to] - base) + seed
            at = to
        breaks = np.cumsum(stop)
        piece = breaks[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.goes_on = np.concatenate([piece[1:] == piece[:-1], [False]]) if len(piece) else np.zeros(0, bool)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and of each pair of neighbours in a piece (at the first of the two)."""
        single = mix(self.words.copy())
        following = np.concatenate([self.words[1:], self.words[:1]])
        return single, mix(single * np.uint64(0x9E3779B97F4A7C15) + following)

    def reach(self, bits: int, often: np.ndarray) -> np.ndarray:
        """How many words the suffix at each place has if it is cut at infrequent words and pairs, 0 to ``DEPTH``."""
        single, pair = self.hashes()
        word_ok = set_in(often, cells_of(single, bits))
        link = self.goes_on & word_ok & np.concatenate([word_ok[1:], [False]]) & set_in(often, cells_of(pair, bits))
        size, going = word_ok.astype(np.int64), word_ok.copy()
        for step in range(1, DEPTH):
            going &= np.concatenate([link[step - 1 :], np.zeros(step - 1, bool)])[: len(going)]
            size += going
        return size

    def codes(self, size: np.ndarray) -> list[np.ndarray]:
        """Hashes of the first 1, 2, 3 and 4 words at each place, no more of them than ``size``."""
        single = self.hashes()[0]
        out = [single]
        for step in range(1, DEPTH):
            following = np.concatenate([single[step:], single[:step]])
            longer = mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + following + np.uint64(step))
            out.append(np.where(size > step, longer, out[-1]))
        return out

    def text(self, first: int, count: int) -> bytes:
        """A phrase, its words parted by one blank each."""
        return b" ".join(self.raw[self.starts[i] : self.ends[i]] for i in range(first, first + count))


def seed_of(lang: str) -> np.uint64:
    units = np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8)
    return Runs(BYTE[units]).at(np.array([0]), np.array([len(units)]))[0]


def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Places]]:
    """Texts of each language in chunks of a few megabytes."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    seeds: dict[str, np.uint64] = {}

    def chunk(lang: str) -> tuple[str, Places]:
        sizes.pop(lang)
        return lang, Places(held.pop(lang), seeds.setdefault(lang, seed_of(lang)))

    for batch in batches:
        for part in small_slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                for data in in_slices(text.as_py() or b""):
                    held.setdefault(lang, []).append(data)
                    sizes[lang] = sizes.get(lang, 0) + len(data)
                    if sizes[lang] > CHUNK_BYTES:
                        yield chunk(lang)
            if len(held) > 64:  # many languages share the memory of a few
                for lang in list(held):
                    yield chunk(lang)
    for lang in list(held):
        yield chunk(lang)


# --- first pass: hashed counts ----------------------------------------------------------------------


def cell_bits(size: int) -> int:
    """So many cells for texts of ``size`` bytes that a cell's share of all words and pairs stays below the least
    count, up to 2**30 cells.

    A bit per cell is broadcast, 128 MB at most; beyond that (some 16 GB of text) cells fill up, fewer suffixes are cut
    before the shuffle, and results stay the same.
    """
    return min(30, max(16, (size // 16).bit_length()))


def cell_counts(texts: DataFrame, bits: int, parts: int, least: int, heavy: int, often: np.ndarray | None) -> DataFrame:
    """``part, often, hot, lang, words``: bits of the cells with ``least`` and more, and the cells with over ``heavy``.

    Without ``often``, words and pairs are counted; with it (the result of that), triples and quadruples of what is
    frequent, and the cells of words in frequent pairs are set: the counts of other words are not needed. Tasks send sorted cells and counts per chunk of text and part of the cells. Rows of part -1 hold the
    number of words of a language instead.
    """
    schema = "part bigint, cells binary, counts binary, lang string, words bigint"
    result = "part bigint, often binary, hot binary, lang string, words bigint"
    target, reply = arrow_of(schema), arrow_of(result)
    edges = np.array([(i << bits) // parts for i in range(parts + 1)])
    shared = texts.sparkSession.sparkContext.broadcast(often)  # at most 128 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        known = shared.value
        for lang, places in places_of(batches):
            if known is None:
                single, pair = places.hashes()
                words[lang] = words.get(lang, 0) + len(single)
                hashes = np.concatenate([single, pair[places.goes_on]])
            else:
                size = places.reach(bits, known)
                codes = places.codes(size)
                hashes = np.concatenate([codes[2][size > 2], codes[3][size > 3]])
            cells, n = np.unique(cells_of(hashes, bits), return_counts=True)
            if known is not None:  # words of frequent pairs get the least count
                linked = size > 1
                linked[1:] |= linked[:-1]
                cells = np.concatenate([cells, cells_of(np.unique(codes[0][linked]), bits)])
                cells, place = np.unique(cells, return_inverse=True)
                n = np.bincount(place, np.concatenate([n, np.full(len(place) - len(n), least)]), len(cells)).astype(np.int64)
            at = np.searchsorted(cells, edges)
            some = [i for i in range(parts) if at[i] < at[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([packed((cells[at[i] : at[i + 1]] - edges[i]).astype(np.uint32)) for i in some], pa.binary()),
                    pa.array([packed(n[at[i] : at[i + 1]].astype(np.uint32)) for i in some], pa.binary()),
                    pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64()),
                ],
                schema=target,
            )
        n = len(words)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()),
            ],
            schema=target,
        )

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        if part < 0:
            for batch in batches:
                n = batch.num_rows
                lang, words = (batch.column(batch.schema.names.index(c)) for c in ("lang", "words"))
                empty = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int64()), empty, empty, lang, words], schema=reply)
            return
        sums = np.zeros(edges[part + 1] - edges[part], np.int64)
        for batch in batches:
            names = batch.schema.names
            for cells, n in zip(batch.column(names.index("cells")), batch.column(names.index("counts"))):
                sums[unpacked(cells.as_py(), np.uint32)] += unpacked(n.as_py(), np.uint32)
        bitmap, hot = packed(np.packbits(sums >= least)), packed(np.flatnonzero(sums > heavy) + edges[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([bitmap]), pa.array([hot]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())],
            schema=reply,
        )

    return materialize(texts.mapInArrow(run, schema).groupBy("part").applyInArrow(total, result), "cells")


def frequent_cells(counts: DataFrame, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """All bits, packed, and the very frequent cells; one row per part of the cells reaches the driver."""
    edges = [(i << bits) // parts for i in range(parts + 1)]
    out, hots = np.zeros(1 << bits, bool), [np.zeros(0, np.int64)]
    for part, often, hot in counts.where("part >= 0").select("part", "often", "hot").collect():
        size = edges[part + 1] - edges[part]
        out[edges[part] : edges[part + 1]] = np.unpackbits(unpacked(often, np.uint8))[:size].astype(bool)
        hots.append(unpacked(hot, np.int64))
    return np.packbits(out), np.sort(np.concatenate(hots))


# --- second pass: suffixes, routed by leading words -------------------------------------------------


def routed_suffixes(
    texts: DataFrame, bits: int, parts: int, often: np.ndarray, longer: np.ndarray, heavy: np.ndarray
) -> DataFrame:
    """``part, lang, suffixes, depths, counts``: suffixes cut where nothing frequent goes on, counted within a task,
    one row for all that go the same way at a time (joined by line breaks, which no word holds).

    ``depth`` says from how many words on a phrase's count is whole in one part. Single words (depth 1, suffix of one
    word) go by that word; longer suffixes by their first two words, those of very frequent pairs by all (depth 4).
    """
    target = arrow_of(SUFFIXES)
    shared = texts.sparkSession.sparkContext.broadcast((often, longer, heavy))  # 256 MB at most, and HOT_CELLS numbers

    def rows_of(store: dict[tuple, list]) -> Iterator[pa.RecordBatch]:
        if not store:
            return
        langs, values = [k[0] for k in store], list(store.values())
        names, lang = np.unique(np.array(langs, object), return_inverse=True)
        part = np.mod(np.array([v[2] for v in values], np.int64), parts)
        order = np.lexsort((part, lang))
        cuts = np.flatnonzero(np.diff(lang[order] * parts + part[order])) + 1
        rows = []
        for some in np.split(order, cuts):
            own = [values[i] for i in some.tolist()]
            rows.append((
                int(part[some[0]]), names[lang[some[0]]], zstandard.ZstdCompressor(level=3).compress(b"\n".join(v[0] for v in own)),
                packed(np.array([v[1] for v in own], np.uint8)), packed(np.array([v[3] for v in own], np.int64)),
            ))
        for low in range(0, len(rows), 1000):
            columns = zip(*rows[low : low + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, more, hot = shared.value
        store: dict[tuple, list] = {}
        for lang, places in places_of(batches):
            size = places.reach(bits, pairs)
            if not len(size):
                continue
            codes = places.codes(size)
            size[(size > 2) & ~set_in(more, cells_of(codes[2], bits))] = 2
            size[(size > 3) & ~set_in(more, cells_of(codes[3], bits))] = 3
            whole = np.choose(np.maximum(size - 1, 0), codes)
            pair = cells_of(places.hashes()[1], bits)
            single_ok = set_in(more, cells_of(codes[0], bits))
            for deep in (False, True):
                at = np.flatnonzero(size > 1 if deep else single_ok)
                keys, first, n = np.unique((whole if deep else codes[0])[at], return_index=True, return_counts=True)
                at = at[first]
                is_hot = np.isin(pair[at], hot)
                words = size[at] if deep else np.ones(len(at), np.int64)
                depth = np.where(is_hot, DEPTH, 2) if deep else words
                route = np.where(is_hot, keys, codes[1][at]) if deep else keys
                columns = (x.tolist() for x in (keys, at, words, depth, route.view(np.int64), n))
                for code, place, count, whole_from, to, times in zip(*columns):
                    key = (lang, code, deep)
                    if key in store:
                        store[key][3] += times
                    else:
                        store[key] = [places.text(place, count), whole_from, to, times]
            if len(store) > STORED_SUFFIXES:
                yield from rows_of(store)
                store = {}
        yield from rows_of(store)

    return texts.mapInArrow(run, SUFFIXES)


# --- multikey quicksort -----------------------------------------------------------------------------


def equal_partitions(words: np.ndarray, weights: np.ndarray, routed: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``(pointer, depth, count)`` of every phrase among suffixes given as rows of word numbers (-1 behind the end).

    Three-way partitions at one depth: those before, at and behind a pivot's word. An equal partition is the phrase of
    the pivot's words down to that depth; its weight is the count. Partitions lighter than ``least`` are abandoned,
    but not above the depth that all their pointers were routed by, where other parts hold the rest.
    """
    waiting = [(np.arange(len(words)), 0)] if len(words) else []
    while waiting:
        pointers, depth = waiting.pop()
        keys = words[pointers, depth]
        pivot = keys[len(keys) // 2]
        for some in (pointers[keys < pivot], pointers[keys > pivot]):
            if len(some) and worth(some, weights, routed, depth, least):
                waiting.append((some, depth))
        if pivot < 0:
            continue  # suffixes that end here
        equal = pointers[keys == pivot]
        if worth(equal, weights, routed, depth, least):
            yield int(equal[0]), depth + 1, int(weights[equal].sum())
            if depth + 1 < words.shape[1]:
                waiting.append((equal, depth + 1))


def worth(pointers: np.ndarray, weights: np.ndarray, routed: np.ndarray, depth: int, least: int) -> bool:
    """Whether a partition may hold a phrase of more than ``depth`` words that is frequent.

    Counts of phrases shorter than ``routed`` words are spread over parts, so these must be handed on however small.
    """
    return weights[pointers].sum() >= least or bool((routed[pointers] > max(depth + 1, 2)).any())


def phrases_of_part(table: pa.Table, least: int, target: pa.Schema) -> pa.Table:
    """Sort the suffixes of one part and give ``lang, phrase, words, n`` of its equal partitions."""
    langs, split, weights, routed = [], [], [], []
    for lang, suffixes, depths, counts in zip(*(table.column(c).to_pylist() for c in ("lang", "suffixes", "depths", "counts"))):
        own = zstandard.ZstdDecompressor().decompress(suffixes).decode().split("\n")
        split += [x.split(" ") for x in own]
        langs += [lang] * len(own)
        routed.append(unpacked(depths, np.uint8))
        weights.append(unpacked(counts, np.int64))
    weights, routed = np.concatenate(weights), np.concatenate(routed)
    known = {w: i for i, w in enumerate(sorted({w for x in split for w in x}))}
    words = np.full((len(split), DEPTH), -1, np.int64)
    for i, x in enumerate(split):
        words[i, : len(x)] = [known[w] for w in x]
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    out = []
    for lang, some in by_lang.items():
        some = np.array(some)
        for kind in (routed[some] == 1, routed[some] > 1):  # single words, then longer suffixes
            own = some[kind]
            for pointer, depth, n in equal_partitions(words[own], weights[own], routed[own], least):
                if depth > 1 or routed[own[pointer]] == 1:  # longer suffixes do not hold all places of their first word
                    out.append((lang, " ".join(split[own[pointer]][:depth]), depth, n))
    columns = list(zip(*out)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)


def frequent_phrases(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases of 2 to 4 words that occur ``least`` times and of their words, and
    ``lang, total`` words."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits, partitions = cell_bits(size), int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell_parts = max(partitions, (1 << bits) >> 21)
    heavy = max(HEAVY, size // HOT_CELLS)  # so at most HOT_CELLS cells, there being less words and pairs than bytes
    counts = cell_counts(texts, bits, cell_parts, least, heavy, None)
    totals = counts.where("part = -1").groupBy("lang").agg(F.sum("words").alias("total"))
    often, hot = frequent_cells(counts, bits, cell_parts)
    longer, _ = frequent_cells(cell_counts(texts, bits, cell_parts, least, heavy, often), bits, cell_parts)
    parts = max(partitions, size // PART_BYTES)
    suffixes = routed_suffixes(texts, bits, parts, often, longer, hot)
    target = arrow_of(PHRASES)

    def part(table: pa.Table) -> pa.Table:
        return phrases_of_part(table, least, target)

    found = suffixes.groupBy("part").applyInArrow(part, PHRASES)
    summed = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return materialize(summed, "phrases"), totals


# --- scores -----------------------------------------------------------------------------------------


def exact(column: str):
    return F.col(column).cast("decimal(19,0)")


def collocations(
    df: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top`` phrases by their weakest cut.

    A phrase of 2 to 4 words that occurs ``a >= least`` times is a candidate; a cut into ``l`` and ``r`` occurrences
    scores floor(2000000 * a / (l + r)), the lowest cut counts, of equal ones the earliest. A candidate inside a longer
    one with 100 * f(longer) >= ``covered`` * a is dropped. Starts jobs that write the counts.
    """
    importable(df.sparkSession)
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    phrases, totals = frequent_phrases(texts, least)
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    # cuts after 1, 2, 3 words
    cuts = candidates.select(
        "*", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast((cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r) as bigint)")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # phrases inside longer candidates
    size = F.col("words")
    inner = candidates.where("words > 2").select(
        "lang", F.col("a").alias("longer"), "words", F.split("phrase", " ").alias("w"),
        F.explode(F.sequence(F.lit(2), size - 1)).alias("len"),
    ).select("lang", "longer", "w", "len", F.explode(F.sequence(F.lit(1), size - F.col("len") + 1)).alias("at")).select(
        "lang", "longer", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("phrase")
    )
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(most, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (exact("longer") * F.lit(100) < exact("a") * F.lit(covered))
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = first_per_group(
        kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score"), ["lang"], order, top
    )
    return ranked.join(totals, "lang").select(
        "lang", F.col("_nth").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
