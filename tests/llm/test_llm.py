"""The training-data operators against brute force, the tokenizer libraries, and planted edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers as files
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalens.llm import blocks, jaccard_join, language, path_dedup, repeats, suffix_dedup
from catalens.llm.components import components
from catalens.llm.embedding_dedup import _labels, meeting_chance, near_vectors
from catalens.llm.html_text import html_texts, visible_text
from catalens.llm.packing import Bins, Ids, pack_documents
from catalens.llm.pieces import Pieces, encode_and_decode
from catalens.llm.token_counts import Counter as TokenCounter
from catalens.llm.token_counts import token_counts
from catalens.llm.topk import top_k

SPEC = "doc_id long, text string, block string, part int, n long"  # with names that the operators use inside
ODD = ["", " ", "\n \n", "a" * 700, "ab " * 200, "é" * 150, "x  y   z", "中文 text", "Same words here and there again " * 9]


def corpus(seed=3, n=50, alphabet="ab "):
    r = random.Random(seed)
    rows = [(i if r.random() < 0.9 else None, "".join(r.choice(alphabet) for _ in range(r.randint(0, 300)))) for i in range(n)]
    rows += [(100 + i, x) for i, x in enumerate(ODD)] + [(200, None), (7, None), (7, "a" * 300), (300, ODD[-1])]
    return rows


def table(spark, rows, slices=4):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SPEC).repartition(slices)


def same(found, wanted):
    order = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)


@pytest.fixture()
def small_blocks(monkeypatch):
    """Many blocks, parts and slices even for small texts."""
    for module in (suffix_dedup, path_dedup):
        monkeypatch.setattr(module, "text_blocks", partial(blocks.text_blocks, block_bytes=1500))
    monkeypatch.setattr(repeats, "part_count", lambda _: 5)
    monkeypatch.setattr(repeats, "_SLICE", 300)


def earlier_bytes(docs, length):
    place = lambda i: -1 if i is None else i
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], 1 << 60), place(i))
    for i, t in docs:
        b = (t or "").encode()
        m = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < place(i):
                m[s : s + length] = [True] * length
        spans = sum(m[j] and (j == 0 or not m[j - 1]) for j in range(len(b)))
        yield i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()


def repeated_words(docs, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[s : s + length]) for w in split for s in range(len(w) - length + 1))
    for (i, _), w in zip(docs, split):
        m = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                m[s : s + length] = [True] * length
        yield i, len(w), sum(m), hashlib.sha256(" ".join(x for x, y in zip(w, m) if not y).encode()).hexdigest()


def test_suffix_dedup(spark, small_blocks):
    docs = corpus()
    found = suffix_dedup.suffix_dedup(table(spark, docs), 12, with_kept=False).collect()
    same(found, list(earlier_bytes(docs, 12)))
    kept = suffix_dedup.suffix_dedup(table(spark, docs), 12, carry=["block", "n"])
    assert kept.where("block = 'x' and n = 2 and kept is not null").count() == len(docs)
    assert suffix_dedup.suffix_dedup(table(spark, []), 50).count() == 0


def test_path_dedup(spark, small_blocks):
    docs = corpus(5)
    found = path_dedup.path_dedup(table(spark, docs), 5, with_kept=False).drop("n_spans").collect()
    same(found, list(repeated_words(docs, 5)))
    assert path_dedup.path_dedup(table(spark, []), 35).count() == 0


def word_sets(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < words else frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


@pytest.mark.parametrize("leaf_shingles, paired", [(1_000_000, 16), (60, 16), (1_000_000, 1), (60, 3), (1_000_000, 200)])
def test_jaccard_join(spark, leaf_shingles, paired):
    r = random.Random(5)
    base = [[r.choice("abcdefghij") for _ in range(r.randint(0, 60))] for _ in range(9)]
    docs = []
    for i in range(120):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            if words:
                words[r.randrange(len(words))] = r.choice("abcdefghijKL")
        docs.append((i, " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "a b c"), (1006, "A  b\tc"), docs[5]]
    sets = [word_sets(t, 4) for _, t in docs]
    links = np.array([[bool(a and b) and 100 * len(a & b) >= 85 * len(a | b) for b in sets] for a in sets])
    label = _labels(links)
    ids = np.array([i for i, _ in docs])
    wanted = [(i, len(s), int(ids[label == k].min()) if s else i) for (i, _), s, k in zip(docs, sets, label)]
    found = jaccard_join.jaccard_components(table(spark, docs), leaf_shingles=leaf_shingles, paired=paired)
    same(found.collect(), wanted)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.12 * r.standard_normal(16)).tolist(), i % 3) for i in range(200)]
    rows += [(500 + i, rows[0][1], 0) for i in range(20)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kinds = np.array([k for *_, k in rows])
    links = (x @ x.T >= 0.93) & (kinds[:, None] == kinds[None, :])
    np.fill_diagonal(links, False)
    odd = [(900, None, 1), (901, [0.0, 0.0], 1), (902, [float("nan"), 1.0], 1), (903, [None, 1.0], 1), (904, [], 1), (905, rows[0][1], None)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    found = {a: (b, c, d) for a, b, c, d in near_vectors(frame, bucket_rows=16).collect()}
    assert all(found[i] == (0, i, True) for i, *_ in odd)
    ids = [i for i, *_ in rows]
    counted = np.array([found[i][0] for i in ids])
    assert (counted <= links.sum(1)).all() and counted.sum() >= 0.9 * links.sum()
    assert meeting_chance(0.93) >= 0.95
    assert near_vectors(frame.limit(0)).count() == 0


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 3.0]) for _ in range(3)]) for i in range(300)]
    rows += [(300, None), (350, []), (351, [None, 1.0]), (352, [float("inf"), 1.0, 1.0]), (400, [1.0]), (401, [2.0]), (500, [0.0] * 3)]
    use = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    wanted = []
    for i, v in use:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in use if j != i and len(w) == len(v))[:5]
            wanted += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(top_k(frame, 50, sample_rows=20, block_rows=16).collect(), wanted)
    assert top_k(frame.limit(0), 50).count() == 0


def texts():
    r = random.Random(1)
    some = list("ab  \n\t '.,1é中<|>▁AÉ") + ["<|endoftext|>", "'s", "\xa0", "\x1d", "̀", "😀", "\r\n", "   ", "the", "Σ", "\x01"]
    return ["".join(r.choice(some) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ODD


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = files.path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), TokenCounter(path)
    assert [count(x) for x in texts()] == [len(library.encode(x).ids) for x in texts()]
    rows = {r.doc_id: r for r in token_counts(table(spark, corpus()), path, 60).collect()}
    assert (rows[200].n_tokens, rows[200].n_bytes, rows[200].over_limit) == (0, 0, False)
    assert rows[103].n_tokens == len(library.encode(ODD[3]).ids) and rows[103].over_limit


def test_sentencepiece(spark):
    import sentencepiece

    path = files.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    found = own.encode(texts())
    assert [x.tolist() for x in found] == library.encode(texts())
    assert [own.decode(x) for x in found] == [library.decode(x.tolist()) for x in found]
    rows = encode_and_decode(table(spark, corpus()), path)
    assert rows.where("not round_trip").count() == 0 and rows.where("doc_id = 200 and n_ids = 0").count() == 1


def unigram_model(tmp_path, scores):
    def field(number, kind, value):
        return bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)

    rows = [("<unk>", 0.0, 2), *((p, s, 1) for p, s in scores.items())]
    data = b""
    for piece, score, kind in rows:
        body = field(1, 2, piece.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        data += field(1, 2, body)
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    return str(path)


def test_unigram_viterbi(tmp_path):
    import sentencepiece

    r = random.Random(4)
    names = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(30)} | {"▁", "▁a", "▁ab", "a", "b", "c"}
    path = unigram_model(tmp_path, {p: -r.random() * 10 for p in sorted(names)})
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    some = ["".join(r.choice("abc d") for _ in range(r.randint(1, 25))) for _ in range(300)]
    score = lambda ids: sum(library.get_score(i) for i in ids)  # noqa: E731  several paths may be as good
    for text, ids, other in zip(some, own.encode(some), library.encode(some)):
        assert abs(score(ids.tolist()) - score(other)) < 1e-4 or 0 in other
        assert (own.decode(ids) == text) == (library.decode(other) == text)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = files.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), Ids(path)
    wanted = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts()]
    assert list(own(texts())) == wanted
    docs = corpus()
    rows = pack_documents(table(spark, docs), path, 64, group_rows=40).collect()
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert sum(r.length for r in rows) == total and all(r.length <= 64 for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(table(spark, []), path, 64).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 4, 7, 5, 3])
    bins = Bins(lengths, 10)
    bins.bins, bins.fill = [[0], [1, 2], [3], [4, 5]], [6, 9, 7, 8]  # 30 in four bins
    before = sum(x * x for x in bins.fill)
    bins.local_search(effort=50)
    assert sum(x * x for x in bins.fill) > before and sum(map(bool, bins.bins)) == 3
    assert sorted(i for b in bins.bins for i in b) == list(range(6)) and max(bins.fill) <= 10


def test_language(spark):
    docs = spark.createDataFrame(pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas())
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.where(~held), rows_per_language=100)
    found = language.predict(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0
    odd = {r.doc_id: r for r in language.predict(table(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "der und die")]), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred == "de"
    nothing = language.fit(docs.where("lang is null"))
    assert nothing(["text"]) == [("und", 0.0, False)]
    least = [(a != b).sum() for i, a in enumerate(language.codewords(9)) for b in language.codewords(9)[:i]]
    assert min(least) >= 8


def test_html():
    page = (
        "<html><head><title>x</title></head><body><h1>Head &amp; line</h1><p>One <b>two</b>three<p>Next   para<br>line"
        "<ul><li>a<li>b<ol><li>x</li><li>y</ol><li>c</ul><table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>"
        "<div style='display:none'>no</div><pre>  keep\n   this</pre><span hidden>h</span>end<script>var a='</p>';</script>"
    )
    assert visible_text(page) == (
        "Head & line\n\nOne twothree\n\nNext para\nline\n\n- a\n- b\n  1. x\n  2. y\n- c\n\n"
        "Name       N\nlong name  1\nb          22\n\n  keep\n   this\n\nend"
    )
    for broken in ("<table>" * 300 + "x", "<div>" * 5000 + "x", "<" * 100, "<a " * 50, "</p></p>", "<td>a<td>b", "a < b <c"):
        visible_text(broken)


def test_html_rows(spark):
    frame = spark.createDataFrame([(1, "<p>a"), (1, None), (None, "")], "page_id long, html string")
    same(html_texts(frame).collect(), [(1, "a", 1), (1, "", 0), (None, "", 0)])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = docs.columns
    inputs = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").toPandas(), inputs.schema)
        assert docs.columns == names
    sets = {r.doc_id: word_sets(r.text, 5) for r in inputs.collect()}
    ids = sorted(sets)
    links = np.array([[bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in ids] for a in ids])
    first = {ids[k] for k in _labels(links)} | {i for i in ids if not sets[i]}
    rest = [(r.doc_id, r.text) for r in inputs.collect() if r.doc_id in first]
    wanted = {i for i, size, n, *_ in earlier_bytes(rest, 50) if n < size or not n}
    assert {r.doc_id for r in docs.collect()} == wanted
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.collect()} == wanted
