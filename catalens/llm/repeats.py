"""Where do runs of ``length`` units (bytes or words) that occur elsewhere lie? Exact, for a whole corpus.

1. *Cover.* Every window of ``length`` units is represented by the run of ``k`` units in it whose hash is the
   least. Equal windows choose the same run at the same offset, so these places are a cover sample that is
   consistent between all copies; about two of ``length - k`` places belong to it. Consecutive windows with
   the same representative form a *bundle*, and only (hash of the representative, hash of the bundle) travel.
2. *Resolving.* Per representative: if all its bundles are alike it does not branch, and a bundle that
   occurs again is settled as a whole. Only where different bundles meet, one copy of each asks about
   its single windows.
3. *Coordinates.* The answers come back to the blocks, which mark the settled windows in their own texts.

``EARLIER`` looks for runs that also start in a document with a smaller id, ``ANYWHERE`` for runs that also
start at any other place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..plans.materialize import materialize
from .blocks import ask, codes_of, from_six_bytes, packed, part_count, six_bytes, unpacked, with_replies
from .common import reclaim
from .hashing import Runs, mix

EARLIER, ANYWHERE = "earlier", "anywhere"
DONE, SETTLED, ASKS, SPEAKS = 0, 1, 2, 3
_PLACE_BITS = 22
_SLICE = 1 << 18  # places hashed at a time: some 36 MB of arrays, of which a worker keeps the powers, 8 MB


def least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Windows:
    """Windows, bundles and marks in the units of one block; works in slices, whatever the length of a text."""

    def __init__(self, units, ends: np.ndarray, length: int, k: int):
        """``units(a, b)`` gives units a to b as 64-bit numbers, ``ends`` where the documents end (in units)."""
        self.units, self.ends, self.length, self.k = units, ends, length, k
        self.total = int(ends[-1]) if len(ends) else 0
        self.doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
        first, last, keys, bundles = [], [], [], []
        for at in range(0, max(0, self.total - length + 1), _SLICE):
            for out, part in zip((first, last, keys, bundles), self._slice(at)):
                out.append(part)
        empty = np.zeros(0, np.int64)
        self.first, self.last = (np.concatenate(x) if x else empty for x in (first, last))
        self.key, self.bundle = (np.concatenate(x) if x else empty.astype(np.uint64) for x in (keys, bundles))

    def _slice(self, at: int):
        length, k = self.length, self.k
        to = min(at + _SLICE + length - 1, self.total)
        runs = Runs(self.units(at, to))
        hashes = runs.all(k)
        places = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        least = least_of_each((hashes & ~low) | places, length - k + 1) & low
        n = len(least)
        whole = self.ends[self.doc[at : at + n]] >= np.arange(at + length, at + length + n)
        start = np.flatnonzero(whole)
        if not len(start):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        chosen = least[start].astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(start)) - 1
        first, last, place = start[head], start[tail], chosen[head]
        key = mix(hashes[place] + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(16)
        shape = ((last - first) * 4096 + (place - first)).astype(np.uint64)
        both = runs.at(first, first + length) * np.uint64(0x9E3779B97F4A7C15) + runs.at(last, last + length)
        return first + at, last + at, key, mix(both + mix(shape))

    def hashes_at(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the windows at sorted ``starts``."""
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            base = int(starts[i])
            j = int(np.searchsorted(starts, base + _SLICE))
            runs = Runs(self.units(base, int(starts[j - 1]) + self.length))
            out[i:j] = runs.at(starts[i:j] - base, starts[i:j] - base + self.length)
            i = j
        return out

    def covered(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which units the windows from each ``first`` to ``last`` cover."""
        begun, ended = (np.bincount(x, minlength=self.total + 1) for x in (first, last + self.length))
        return np.cumsum((begun - ended)[:-1]) > 0


def groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns sorted together."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return new


class Bundles:
    """The distinct (key, bundle) pairs of a block in the order of the keys, and who has them."""

    def __init__(self, windows: Windows, ids: np.ndarray):
        self.windows = windows
        order = np.lexsort((windows.bundle, windows.key))  # stable: ascending ids stay ascending
        new = groups(windows.key[order], windows.bundle[order])
        self.order, self.head = order, np.flatnonzero(new)
        self.number = np.cumsum(new) - 1  # of the pair, for each entry of ``order``
        self.owner = order[self.head]  # the bundle of the first document that has the pair
        self.key, self.bundle = windows.key[self.owner], windows.bundle[self.owner] >> np.uint64(16)
        self.owner_id = ids[windows.doc[windows.first[self.owner]]] if len(order) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(self.head, len(order)))
        self.ids = ids

    def extra(self, how: str):
        def of(s: slice) -> bytes:
            more = self.owner_id[s] if how == EARLIER else (self.count[s] > 1).astype(np.uint8)
            return six_bytes(self.bundle[s]) + packed(more)

        return of


def _joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    arrays = [from_six_bytes(x) for x in keys]
    return np.concatenate(arrays), np.cumsum([len(x) for x in arrays])[:-1]


def answer_bundles(how: str):
    """What to do with each (key, bundle) of a part."""

    def answer(keys: list[bytes], more: list[bytes]) -> list[np.ndarray]:
        key, cuts = _joined(keys)
        sizes = [len(x) // 6 for x in keys]
        bundle = np.concatenate([from_six_bytes(m[: 6 * n]) for m, n in zip(more, sizes)])
        kind = np.int64 if how == EARLIER else np.uint8
        own = np.concatenate([unpacked(m[6 * n :], kind) for m, n in zip(more, sizes)])
        order = np.lexsort((own, bundle, key)) if how == EARLIER else np.lexsort((bundle, key))
        key, bundle, own = key[order], bundle[order], own[order]
        by_key, by_pair = groups(key), groups(key, bundle)
        heads, pair_heads = np.flatnonzero(by_key), np.flatnonzero(by_pair)
        of_key, of_pair = np.cumsum(by_key) - 1, np.cumsum(by_pair) - 1
        branching = (np.add.reduceat(by_pair.astype(np.int64), heads) > 1)[of_key]
        out = np.zeros(len(key), np.uint8)
        if how == EARLIER:
            least, most = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
            branching &= (least != most)[of_key]
            later = own > own[pair_heads][of_pair]
            out[branching] = ASKS
            # of equal pairs of one document in several blocks, one speaks for all; the others follow its windows
            out[later] = SETTLED
        else:
            total = np.add.reduceat(own.astype(np.int64) + 1, pair_heads)[of_pair]
            out[branching] = ASKS
            out[total > 1] = SETTLED
            out[by_pair & branching & (total > 1)] = SPEAKS
        back = np.empty_like(out)
        back[order] = out
        return np.split(back, cuts)

    return answer


class Singles:
    """The distinct windows of a block's speaking bundles."""

    def __init__(self, bundles: Bundles, codes: np.ndarray, how: str):
        windows = bundles.windows
        if how == EARLIER:  # every copy in the first document; those in later ones are settled
            own = bundles.ids[windows.doc[windows.first[bundles.order]]] == bundles.owner_id[bundles.number]
            speaking = bundles.order[own & (codes[bundles.number] >= ASKS)] if len(codes) else bundles.owner
            weight = np.ones(len(speaking), np.uint8)
        else:
            speaking = bundles.owner[codes >= ASKS]
            weight = (codes[codes >= ASKS] == SPEAKS).astype(np.uint8) + 1
        order = np.argsort(speaking)
        speaking, weight = speaking[order], weight[order]
        first, size = windows.first[speaking], windows.last[speaking] - windows.first[speaking] + 1
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.start = np.repeat(first, size) + offset
        weight = np.repeat(weight, size)
        value = windows.hashes_at(self.start)
        self.order = np.argsort(value, kind="stable")  # windows are in the order of the ids
        value = value[self.order]
        new = groups(value)
        self.head, self.number = np.flatnonzero(new), np.cumsum(new) - 1
        self.value = value[self.head]
        self.doc_ids = bundles.ids[windows.doc[self.start[self.order]]] if len(value) else np.zeros(0, np.int64)
        self.owner_id = self.doc_ids[self.head]
        self.weight = np.add.reduceat(weight[self.order].astype(np.int64), self.head) if len(value) else np.zeros(0, np.int64)

    @property
    def key(self) -> np.ndarray:
        return self.value >> np.uint64(16)

    def extra(self, how: str):
        def of(s: slice) -> bytes:
            more = self.owner_id[s] if how == EARLIER else np.minimum(self.weight[s], 2).astype(np.uint8)
            return self.value[s].astype("<u2").tobytes() + packed(more)

        return of


def answer_singles(how: str):
    """Whether each window of a part also starts in a smaller document (or, else, anywhere else)."""

    def answer(keys: list[bytes], more: list[bytes]) -> list[np.ndarray]:
        key, cuts = _joined(keys)
        sizes = [len(x) // 6 for x in keys]
        low = np.concatenate([np.frombuffer(m[: 2 * n], "<u2") for m, n in zip(more, sizes)])
        kind = np.int64 if how == EARLIER else np.uint8
        own = np.concatenate([unpacked(m[2 * n :], kind) for m, n in zip(more, sizes)])
        value = key << np.uint64(16) | low.astype(np.uint64)
        order = np.argsort(value, kind="stable")
        value, own = value[order], own[order]
        new = groups(value)
        heads, number = np.flatnonzero(new), np.cumsum(new) - 1
        if how == EARLIER:
            out = own > np.minimum.reduceat(own, heads)[number]
        else:
            out = np.add.reduceat(own.astype(np.int64), heads)[number] > 1
        back = np.empty(len(out), np.uint8)
        back[order] = out
        return np.split(back, cuts)

    return answer


def marked(bundles: Bundles, codes: np.ndarray, singles: Singles, found: np.ndarray, how: str) -> np.ndarray:
    """Units of a block that are covered by windows which occur elsewhere."""
    windows, ids = bundles.windows, bundles.ids
    settled = np.zeros(len(windows.key), bool)
    if len(codes):
        of_entry = codes[bundles.number]
        again = of_entry == SETTLED
        if how == EARLIER:
            again |= ids[windows.doc[windows.first[bundles.order]]] > bundles.owner_id[bundles.number]
        else:
            again |= of_entry == SPEAKS
        settled[bundles.order] = again
    first, last = windows.first[settled], windows.last[settled]
    if len(found):
        hit = found[singles.number] > 0
        if how == EARLIER:
            hit |= singles.doc_ids > singles.owner_id[singles.number]
        alone = singles.start[singles.order[hit]]
        first, last = np.concatenate([first, alone]), np.concatenate([last, alone])
    return windows.covered(first, last)


def stages(units_of, length: int, k: int, how: str):
    """The three functions over a block's row: bundles to ask about, windows to ask about, marked units."""

    def bundles_of(row: dict) -> Bundles:
        units, ends, ids = units_of(row)
        return Bundles(Windows(units, ends, length, k), ids)

    def ask_bundles(row: dict):
        b = bundles_of(row)
        return b.key, b.extra(how)

    def ask_singles(row: dict):
        s = Singles(bundles_of(row), codes_of(row["bundles"]), how)
        return s.key, s.extra(how)

    def mark(row: dict) -> np.ndarray:
        b, codes = bundles_of(row), codes_of(row["bundles"])
        return marked(b, codes, Singles(b, codes, how), codes_of(row["singles"]), how)

    return ask_bundles, ask_singles, mark


def find(blocks, units_of, length: int, k: int, how: str):
    """Blocks joined with what they need to mark their units, and the function that marks a row's units.

    Starts jobs: both rounds of answers are written to the shared folder.
    """
    parts = part_count(blocks)
    ask_bundles, ask_singles, mark = stages(units_of, length, k, how)
    bundles = materialize(ask(blocks, ask_bundles, answer_bundles(how), parts), "bundles")
    reclaim(blocks.sparkSession)
    known = with_replies(blocks, bundles=bundles)
    singles = materialize(ask(known, ask_singles, answer_singles(how), parts), "singles")
    reclaim(blocks.sparkSession)
    return with_replies(blocks, bundles=bundles, singles=singles), mark


def runs_of(mask: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(marked units, maximal marked runs)`` of each document."""
    counts = np.concatenate([[0], np.cumsum(mask)])
    begins = np.ones(len(mask), bool)
    begins[1:] = ~mask[:-1]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    begins[starts[starts < len(mask)]] = True
    heads = np.concatenate([[0], np.cumsum(mask & begins)])
    yield from zip((counts[ends] - counts[starts]).tolist(), (heads[ends] - heads[starts]).tolist())
