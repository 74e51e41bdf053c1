"""Document fingerprints by spot signatures, for whole texts and against their neighbours.

A spot starts at an anchor, one of the common words below, and is the chain of the next ``CHAIN`` content words
(words that are no common words) behind it; near the end of a text a chain may be shorter. A text's fingerprint is
the set of its spots, each a 48-bit hash, in ascending order as 12 hex digits. A text with words but no spot has one
spot, its whole sequence of words; a text without words has none. Words are runs of letters, digits and marks, in
lower case, of the whole text. The likeness of two fingerprints is their Jaccard similarity; two empty ones are alike.

Two texts are near if their likeness is 0.8 or more. Sets are parted into ranges of set length, so wide that a set can
only be near to sets in its own range or the next; within them a comparison stops as soon as the spots that are left
cannot decide it. The likeness itself is always counted in full.

``edited_fingerprints`` needs each document's successor. Rows are dealt to ranges of (id, hash of the text) whose
borders come from a sample of ids; the first row of every range also goes to the range before it, so each text
moves once. Null ids come first; equal ids are ordered by the text's hash, then the text. Null text is empty.
A single document is its own successor. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_of, importable, two_columns

CHAIN = 3
WORD = re.compile(r"\w+")
# fixed values: common words, those that anchor a spot first
ANCHORS = frozenset(
    "the a an is are was were be to that do did have has had le la les des est sont que der die das ist sind "
    "war ein eine el los las es son que un una".split()
)
COMMON = ANCHORS | frozenset(
    "of and in on at by for from with as it its he she they we you i this these those or but not no so if then than "
    "du de et en dans pour par sur avec il elle ils nous vous je ne pas ou mais si au aux ce cette ces "
    "und oder aber nicht mit von zu auf für im den dem des er sie wir ihr ich wenn als auch "
    "y o pero no con por para del al lo su se me mi si como más".split()
)
NEAR = 80  # percent
BORDERS = 4096
RANGES_PER_PARTITION = 4
HEX = 12


def spots(text: str) -> np.ndarray:
    """The spots of a text as sorted 48-bit numbers."""
    hashed = xxhash.xxh64_intdigest
    words = WORD.findall(text.lower())
    content, starts = [], set()  # a chain starts behind its anchor, at that number of content words
    for word in words:
        if word not in COMMON:
            content.append(word)
        elif word in ANCHORS:
            starts.add((len(content), word))
    found = {hashed(" ".join([anchor, *content[at : at + CHAIN]])) for at, anchor in starts if at < len(content)}
    if words and not found:
        found.add(hashed(" ".join(words)))
    return np.unique(np.fromiter((x >> 16 for x in found), np.int64, len(found)))


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def spots_of(text: str) -> np.ndarray:
    """The spots in a fingerprint."""
    raw = np.zeros((len(text) // HEX, 8), np.uint8)
    raw[:, 2:] = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view(">u8").astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def length_range(n: int, percent: int = NEAR) -> int:
    """Number of the range of set length; sets in ranges further apart than 1 cannot be ``percent`` alike."""
    low, number = 1, 0
    while n >= (low := low * 100 // percent + 1):
        number += 1
    return number if n else -2


def near(a: np.ndarray, b: np.ndarray, percent: int = NEAR, step: int = 64) -> bool:
    """Whether the similarity is at least ``percent``."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if abs(length_range(len(a), percent) - length_range(len(b), percent)) > 1:
        return False
    needed = -(-percent * (len(a) + len(b)) // (100 + percent))  # spots that must be shared
    i = j = shared = 0
    while shared < needed:
        if shared + min(len(a) - i, len(b) - j) < needed:
            return False
        edge = min(a[min(i + step, len(a)) - 1], b[min(j + step, len(b)) - 1])
        to_i, to_j = (int(np.searchsorted(x, edge, "right")) for x in (a, b))
        shared += len(np.intersect1d(a[i:to_i], b[j:to_j], assume_unique=True))
        i, j = to_i, to_j
    return True


# --- a document, its edited text and its successor --------------------------------------------------

ROWS = "doc bigint, text string, mark bigint, slot int, guest boolean"
OUT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, length_range int, is_near_edited boolean, is_near_next boolean"
)


def range_borders(places: DataFrame, count: int) -> list[tuple]:
    """Borders of about ``count`` ranges of (id, mark).

    They come from the distinct places whose hash falls in a share of the hashes, about two per range whatever the size
    of the table (at least ``BORDERS``). Borders decide where a row is worked on, never the result.
    """
    share = max(1, places.count() // max(BORDERS, 2 * count))
    picked = places.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(share)) == 0).distinct().toArrow()
    placed = sorted((d is not None, d or 0, m) for d, m in zip(*(picked.column(i).to_pylist() for i in range(2))))
    return sorted({placed[i * len(placed) // count] for i in range(1, count)}) if placed else []


def first_rows(places: DataFrame, borders: list[tuple]) -> dict[tuple, int]:
    """For the first place of each range, the range before it that has rows (for the very first, the last one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for batch in batches:
            for d, m in zip(*(batch.column(i).to_pylist() for i in range(2))):
                place = (d is not None, d or 0, m)
                slot = bisect_right(borders, place)
                if slot not in least or place < least[slot]:
                    least[slot] = place
        columns = list(zip(*((slot, *place) for slot, place in least.items()))) or [()] * 4
        kinds = pa.int32(), pa.bool_(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slot", "known", "doc", "mark"])

    found = places.mapInArrow(run, "slot int, known boolean, doc bigint, mark bigint")
    least = found.groupBy("slot").agg(F.min(F.struct("known", "doc", "mark")).alias("p")).select("slot", "p.*")
    heads = sorted(map(tuple, least.collect()))  # one per range
    return {row[1:]: heads[i - 1][0] for i, row in enumerate(heads)}


def in_ranges(rows: DataFrame, borders: list[tuple], before: dict[tuple, int]) -> DataFrame:
    """Rows with the number of their range; first rows once more, as guests of the range before."""
    target = arrow_of(ROWS)
    known = rows.sparkSession.sparkContext.broadcast((borders, before))  # at most two entries per range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, wanted = known.value
        for batch in batches:
            docs, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            places = [(d is not None, d or 0, m) for d, m in zip(docs, marks)]
            own, no = [bisect_right(edges, x) for x in places], [False] * len(places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(no)], schema=target)
            at = [i for i, x in enumerate(places) if x in wanted]
            if at:
                columns = [c.take(pa.array(at)) for c in batch.columns]
                to = pa.array([wanted[places[i]] for i in at], pa.int32())
                yield pa.RecordBatch.from_arrays([*columns, to, pa.array([True] * len(at))], schema=target)

    return rows.mapInArrow(run, ROWS)


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, then the
    range of its set's length and whether the edited and the next text are near.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in ascending order of ids; the last one's next is the first. Starts jobs that read ids and hashes.
    """
    spark = df.sparkSession
    importable(spark)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = two_columns(df, key, text).select(F.col("key").alias("doc"), "text", mark.alias("mark"))
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = rows.select("doc", "mark")
    borders = range_borders(places, partitions * RANGES_PER_PARTITION)
    return _neighbours(in_ranges(rows, borders, first_rows(places, borders)), partitions, key)


def _neighbours(rows: DataFrame, partitions: int, key: str) -> DataFrame:
    """Walk each range in order, a row at a time with its successor."""
    schema = f"`{key}` bigint, {OUT}"
    target = arrow_of(schema)
    dealt = rows.repartition(partitions, "slot").sortWithinPartitions(
        "slot", "guest", F.col("doc").asc_nulls_first(), "mark", F.coalesce("text", F.lit(""))
    )

    def result(doc, text: str, own: np.ndarray, after: str, next_spots: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = own if edited == text else spots(edited)
        sha = hashlib.sha256(edited.encode("utf-8")).hexdigest()
        return (
            doc, len(text), sha, fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, next_spots),
            length_range(len(own)), near(own, changed), near(own, next_spots),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size, settled = None, [], 0, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            for doc, text, slot, guest in zip(*(batch.column(i) for i in (0, 1, 3, 4))):
                doc, text, slot, guest = doc.as_py(), text.as_py() or "", slot.as_py(), guest.as_py()
                if settled == slot:  # further rows at the same place as the guest
                    continue
                own = held[2] if held and held[1] == text else spots(text)
                if held:
                    out.append(result(*held, text, own))
                    size += len(out[-1][3]) + len(out[-1][4]) + 150
                held, settled = (None, slot) if guest else ((doc, text, own), None)
                if size > 1 << 22:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return dealt.mapInArrow(run, schema)
