"""What hashing a block of text holds in a worker, beside the block and while the worker is idle."""

from __future__ import annotations

import tracemalloc

import numpy as np

from catalens.llm import hashing
from catalens.llm.blocks import BLOCK_BYTES
from catalens.llm.hashing import BYTE, word_hashes
from catalens.llm.repeats import Windows


def held(work) -> tuple[float, float]:
    """MB at the peak of ``work`` and after it."""
    hashing._powers.cache_clear()
    tracemalloc.start()
    work()
    after, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return peak / 1e6, after / 1e6


def test_a_block_is_hashed_in_little_memory():
    data = np.random.default_rng(2).integers(97, 123, BLOCK_BYTES).astype(np.uint8)
    data[::9] = 32
    ends = np.arange(1, 513) * (BLOCK_BYTES // 512)
    peak, after = held(lambda: Windows(lambda a, b: BYTE[data[a:b]], ends, 50, 24))
    assert peak < 70 and after < 20, (peak, after)
    peak, after = held(lambda: word_hashes(data, ends))
    assert peak < 70 and after < 20, (peak, after)


def test_slices_do_not_change_words():
    data = np.frombuffer(b"one two  three\nfour " * 400, np.uint8)
    ends = np.array([3, 3, 1000, len(data)])
    wanted = word_hashes(data, ends, 1 << 20)
    for size in (1, 7, 100):
        assert all((a == b).all() for a, b in zip(word_hashes(data, ends, size), wanted))
