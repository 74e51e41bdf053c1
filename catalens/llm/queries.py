"""The operators bound to the test tables, as digests of their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .collocations import collocations
from .embedding_dedup import near_vectors
from .html_text import html_texts
from .jaccard_join import jaccard_components
from .lexical import lexical_top_k
from .packing import pack_documents
from .path_dedup import path_dedup
from .pieces import encode_and_decode
from .spots import edited_fingerprints
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .topk import top_k

CAPACITY = 4096
WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_near_dedup(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"), threshold=0.93)


def op2_html_extraction(spark, folder):
    return html_texts(table(spark, folder, "pages"))


def op3_best_fit_packing(spark, folder):
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE), CAPACITY)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))  # a null id has no remainder


def op4_language_id(spark, folder):
    documents = table(spark, folder, "documents")
    model = language.fit(documents.where(~held_out()))
    return language.predict(documents, model).withColumn("held_out", held_out())


def op5_ngram_jaccard_join(spark, folder):
    return jaccard_components(table(spark, folder, "documents"), words=4, percent=85)


def op6_substring_dedup(spark, folder):
    return path_dedup(table(spark, folder, "documents"), length=35, with_kept=False)


def op7_sentencepiece(spark, folder):
    return encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path(PIECE_BPE))


def op8_exact_top_k(spark, folder):
    return top_k(table(spark, folder, "embeddings"), every=50, k=5, scale=256)


def op9_token_counts(spark, folder):
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


def op10_suffix_array_dedup(spark, folder):
    return suffix_dedup(table(spark, folder, "documents"), length=50, with_kept=False)


def op11_lexical_search(spark, folder):
    return lexical_top_k(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


def op12_document_fingerprints(spark, folder):
    return edited_fingerprints(table(spark, folder, "documents"))


def op13_phrase_collocations(spark, folder):
    return collocations(table(spark, folder, "documents"), least=30, covered=80, top=2000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_html_extraction, op3_best_fit_packing, op4_language_id, op5_ngram_jaccard_join,
        op6_substring_dedup, op7_sentencepiece, op8_exact_top_k, op9_token_counts, op10_suffix_array_dedup,
        op11_lexical_search, op12_document_fingerprints, op13_phrase_collocations,
    )
}

LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS_SQL = rf"unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

SQL = {
    "op11_lexical_search": f"""
        WITH term AS (SELECT doc_id, {TERMS_SQL} AS term FROM documents),
        doc AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM doc),
        entry AS (
          SELECT doc_id, term, count(*) AS tf, 100 - 25 + ((25 * any_value(n) * any_value(docs)) // any_value(total)) AS m
          FROM term JOIN doc USING (doc_id), corpus GROUP BY doc_id, term),
        weight AS (
          SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM entry, corpus GROUP BY term),
        asked AS (
          SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {TERMS_SQL} AS term FROM benchmark) GROUP BY ALL),
        scored AS (
          SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
          FROM asked JOIN weight USING (term) JOIN entry USING (term) GROUP BY item_id, doc_id),
        ranked AS (
          SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
            doc_id, score
          FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op13_phrase_collocations": rf"""
        WITH piece AS (
          SELECT coalesce(lang, 'und') AS lang,
            regexp_extract_all(unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
          FROM documents),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
        place AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (VALUES (1), (2), (3), (4)) s(k)),
        often AS (
          SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS f
          FROM place GROUP BY ALL HAVING count(*) >= 30),
        split AS (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE words > 1),
        cut AS (SELECT *, unnest(range(1, words)) AS k FROM split),
        scored AS (
          SELECT c.lang, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r,
            (CAST(2000000 AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) + y.f) AS score
          FROM cut c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
          JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        part AS (SELECT lang, f, w, words, unnest(range(2, words)) AS len FROM split WHERE words > 2),
        longer AS (
          SELECT lang, array_to_string(w[i:i + len - 1], ' ') AS phrase, max(f) AS f
          FROM (SELECT *, unnest(range(1, words - len + 2)) AS i FROM part) GROUP BY ALL),
        kept AS (
          SELECT w.* FROM lowest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase
          WHERE o.f IS NULL OR CAST(100 AS HUGEINT) * o.f < CAST(80 AS HUGEINT) * w.a),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op8_exact_top_k": """
        WITH usable AS (
          SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
          FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
          WHERE q.vec_id % 50 = 0),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id, score
          FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
