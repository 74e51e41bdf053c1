"""Token counts of byte-level BPE by heap-and-linked-list merging; no identifiers are made.

The count of a pretoken is its number of symbols minus the number of merges. Candidate pairs wait in a heap by
(rank, place); the symbols form a linked list, so a merge costs O(log n) and a pretoken of n bytes O(n log n),
also when a text has no space at all.

Null text counts as empty (0 bytes, 0 tokens). Rows are independent: repeated rows and repeated or null ids
each give their own row. Other columns of the table are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, text_rows

#: Fixed value: the split of byte-level BPE before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LOW = (1 << 32) - 1
CROWDED = 1 << 40
GONE = 1 << 60  # a symbol that is in no pair


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in names)
    return [x for _, x in sorted((names | {b: chr(256 + i) for i, b in enumerate(rest)}).items())]


class Counter:
    """Counts the tokens of texts for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        odd = [x for x in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges") if model.get(x)]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        ids = model["vocab"]
        self.byte_ids = [ids[x] for x in byte_symbols()]
        self.ranks, self.merged_ids = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)
            self.merged_ids.append(ids[a + b])
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.ends_white = regex.compile(r"\s\Z")
        self.crowded = regex.compile(r"\s (?:\s|\Z)")
        self.after_space, self.bare, self.words = WordCache(), WordCache(), WordCache()

    def merged(self, word: str) -> int:
        """Tokens of one pretoken. A heap entry is ``rank << 32 | place``; it is stale if the pair there has gone."""
        symbols = [self.byte_ids[b] for b in word.encode("utf-8")]
        size = count = len(symbols)
        rank_of, merged = self.ranks.get, self.merged_ids
        heap = [
            rank << 32 | i
            for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            if (rank := rank_of(a << 32 | b)) is not None
        ]
        if not heap:
            return count
        heapq.heapify(heap)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        symbols.append(GONE)  # also what stands right of the last symbol
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & LOW, entry >> 32
            j = right[i]
            if rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue
            symbols[i] = new = merged[rank]
            symbols[j] = GONE
            right[i] = after = right[j]
            count -= 1
            if after < size:
                left[after] = i
                rank = rank_of(new << 32 | symbols[after])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | i)
            before = left[i]
            if before >= 0:
                rank = rank_of(symbols[before] << 32 | new)
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | before)
        return count

    def pretokens(self, text: str) -> int:
        count, words = 0, self.words
        for word in self.split.findall(text):
            known = words.get(word)
            if known is None:
                known = self.merged(word)
                if len(word) < 40:
                    words[word] = known
            count += known
        words.make_room()
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A pretoken begins at every space, unless white space stands on both sides of it; so the pieces
        between spaces are counted on their own, and each is counted once as long as it stays cached. The
        count of a piece that ends in white space carries CROWDED, which sends the text to a closer look.
        """
        first, *rest = text.split(" ")
        for cache, words, lead in ((self.bare, (first,), ""), (self.after_space, rest, " ")):
            for word in [x for x in set(words) if x not in cache]:
                cache[word] = self.pretokens(lead + word) + CROWDED * bool(self.ends_white.search(lead + word))
        count = self.bare[first] + sum(map(self.after_space.__getitem__, rest))
        self.bare.make_room()
        self.after_space.make_room()
        if count < CROWDED:
            return count
        return self.pretokens(text) if self.crowded.search(text) else count % CROWDED

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        found = len(self.special.findall(text))
        return self.plain(text) if not found else found + sum(map(self.plain, self.special.split(text)))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` per row; ``path`` is a tokenizer file on every worker."""

    def work(texts):
        count = counter(path)
        return [(len(x.encode("utf-8")), count(x)) for x in texts]

    out = text_rows(df, key, text, work, "n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
