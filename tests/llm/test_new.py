"""Lexical search, fingerprints and collocations against brute force, with nulls, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from catalens.llm import collocations, language, lexical, spots
from catalens.llm.collocations import equal_partitions
from catalens.llm.lexical import BallTree, lexical_top_k

SPEC = "doc_id long, text string, lang string, part int, n long, ask string"  # with names that operators use inside
WORDS = "the of a Red blue green Fish être straße x9 über und la casa".split()


def corpus(seed, n=60, longest=60):
    r = random.Random(seed)
    join = lambda k: "".join(r.choice(WORDS) + r.choice([" ", "  ", "\t", ", ", ".\n", " - "]) for _ in range(k))
    rows = [(i, join(r.randint(0, longest)), r.choice(["en", "de", None])) for i in range(n)]
    rows += [(100 + i, rows[3][1], rows[3][2]) for i in range(25)]
    return rows + [(200, None, "en"), (201, "", None), (202, "...", "fr"), (203, "the the the", "en"), (None, rows[5][1], "en"), (7, "Red Red", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SPEC).repartition(3)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t, _ in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    for item, text in items:
        asked, out = Counter(terms(text)), []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
                for t, c in asked.items() if t in b
            )
            if score > 0:
                out.append((-score, d is None, d or 0))
        yield from ((item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(out)[:k]))


def key(row):
    return tuple((v is not None, v) for v in row)


def test_lexical_search(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 9)
    monkeypatch.setattr(lexical, "BATCH_ITEMS", 3)
    docs = corpus(1)
    items = [(i, " ".join(random.Random(i).choices(WORDS, k=i))) for i in range(9)] + [(50, None), (51, "Red Red fish"), (51, "nowhere")]
    asked = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, part int")
    found = lexical_top_k(frame(spark, docs), asked, k=12).collect()
    assert sorted(map(tuple, found), key=key) == sorted(ranked(docs, items, 12), key=key)
    assert lexical_top_k(frame(spark, docs).limit(0), asked).count() == 0
    assert lexical_top_k(frame(spark, docs), asked.limit(0)).count() == 0


def test_bounds_of_balls_hold():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 8, 300)
    dims = np.concatenate([r.choice(40, s, False) for s in sizes])
    values = r.random(len(dims)) * 1e6
    tree = BallTree(dims, values, np.cumsum(sizes), 40, leaf=5)
    assert sorted(tree.order.tolist()) == list(range(300)) and len(tree.nodes) > 50
    query = np.arange(0, 40, 3)
    weight = r.random(len(query))
    scores = np.array([tree.dense(d)[query] @ weight for d in tree.order])
    for bound, (first, last, *_) in zip(tree.bounds(query, weight), tree.nodes):
        assert scores[first:last].max() <= bound


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(spots, "BORDERS", 10)
    docs = corpus(4)
    order = sorted(((d is not None, d or 0), t or "") for d, t, _ in docs)
    assert len({p for p, _ in order}) == len(order) - 1  # id 7 twice: either of its rows may come first
    found = [tuple(r) for r in spots.edited_fingerprints(frame(spark, docs)).collect()]
    assert len(found) == len(docs)
    by_text, follows = defaultdict(set), defaultdict(set)
    for i, (_, t) in enumerate(order):
        follows[t].add(order[(i + 1) % len(order)][1])
    seven = [t for p, t in order if p == (True, 7)]
    for a, b in (seven, seven[::-1]):
        follows[a].add(b)
        follows[a] |= follows[b]
        for text in list(follows):
            if a in follows[text] or b in follows[text]:
                follows[text] |= {a, b}
    texts = defaultdict(list)
    for d, t, _ in docs:
        texts[d].append(t or "")
    for d, n, sha, own, edited, near_edited, near_next, *_ in found:
        good = False
        for t in texts[d]:
            for after in follows[t]:
                new = t[: n - n // 2] + after[: n // 2]
                if n == len(t) and hashlib.sha256(new.encode()).hexdigest() == sha:
                    a, b, c = (set(spots.spots(x).tolist()) for x in (t, new, after))
                    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
                    if own == spots.fingerprint(spots.spots(t)) and near_edited == like(a, b) and near_next == like(a, c):
                        assert edited == spots.fingerprint(spots.spots(new))
                        good = True
                        by_text[t].add(own)
        assert good, d
    assert all(len(x) == 1 for x in by_text.values())
    assert spots.edited_fingerprints(frame(spark, docs).limit(0)).count() == 0
    one = spots.edited_fingerprints(frame(spark, [(1, "the red fish", "en")])).collect()
    assert one[0].near_next == 1.0


def test_near_agrees_with_likeness():
    r = np.random.default_rng(3)
    for _ in range(400):
        a, b = (np.unique(r.integers(0, 400, r.integers(0, 300))) for _ in range(2))
        assert spots.near(a, b, 30) == (100 * spots.likeness(a, b) >= 30)
        assert (spots.spots_of(spots.fingerprint(a)) == a).all()


def best_phrases(rows, least, covered, top):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        out = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            out.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], score))
        for i, x in enumerate(sorted(out)[:top]):
            yield (lang, i + 1, x[3], *x[4:7], n[lang], x[7])


@pytest.mark.parametrize("heavy", [1 << 17, 5])
def test_collocations(spark, monkeypatch, heavy):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 600)
    monkeypatch.setattr(collocations, "STORED_SUFFIXES", 40)
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    monkeypatch.setattr(collocations, "HOT_CELLS", 1 << 30)
    monkeypatch.setattr(collocations, "PART_BYTES", 2000)
    docs = corpus(6, n=150)
    found = collocations.collocations(frame(spark, docs), least=4, covered=80, top=30).collect()
    assert sorted(map(tuple, found)) == sorted(best_phrases(docs, 4, 80, 30))
    assert collocations.collocations(frame(spark, docs).limit(0)).count() == 0


def test_equal_partitions_count_prefixes():
    r = np.random.default_rng(5)
    words = r.integers(0, 4, (500, 4))
    words[np.arange(500), r.integers(1, 4, 500)] = -1
    words[np.cumsum(words < 0, 1) > 0] = -1
    weights = r.integers(1, 4, 500)
    wanted = Counter()
    for row, n in zip(words.tolist(), weights.tolist()):
        for k in range(1, 5):
            if -1 not in row[:k]:
                wanted[tuple(row[:k])] += n
    found = {tuple(words[p, :d].tolist()): n for p, d, n in equal_partitions(words, weights, np.full(500, 2), 20)}
    assert found == {p: n for p, n in wanted.items() if n >= 20}


def test_language_learns_each_row_under_its_own_label(spark):
    rows = [(1, "abc abd abe", "x"), (1, "xyz xyw xyv", "y"), (None, "abc abd", "x"), (None, None, "y"), (2, "", None)]
    rows = [(*r, 1, 2, "q") for r in rows]
    df = spark.createDataFrame(rows, SPEC)
    model = language.fit(df)
    found = language.predict(df, model).collect()
    assert [(r.lang_pred, r.ambiguous) for r in found] == [("x", False), ("y", False), ("x", False), ("und", False), ("und", False)]
    assert language.in_known_language(df, model).columns == df.columns
    assert language.in_known_language(df, model).count() == 3
    long = "ab" * 100_000
    assert model([long])[0][0] == "x"
    assert language.predict(df.limit(0), language.fit(df.limit(0))).count() == 0
