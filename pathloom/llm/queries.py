"""The registered query of each operator here, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import (
    bpe,
    conversations,
    divergence,
    exact_dedup,
    language_model,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    quality,
    secret_scan,
    vector_search,
)
from pathloom.llm.common import read_table

BYTE_BPE = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), capacity=8192)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read_table(spark, sf_dir, "documents"), n=5, percent=80)


OP2_SQL = """
WITH RECURSIVE split AS (
    SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\\x20\\x09-\\x0D]+') IF w <> ''] AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles
    FROM split
), listed AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), met AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny
    FROM listed a JOIN listed b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM met WHERE 100 * common >= 80 * (nx + ny - common)
    UNION ALL
    SELECT y, x FROM met WHERE 100 * common >= 80 * (nx + ny - common)
), reach(doc_id, other) AS (
    SELECT x, y FROM links
    UNION
    SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT s.doc_id, CAST(len(any_value(s.shingles)) AS BIGINT) AS n_shingles, coalesce(min(r.other), s.doc_id) AS component_id
FROM sets s LEFT JOIN reach r ON r.doc_id = s.doc_id
GROUP BY s.doc_id
"""


def op3_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digests(read_table(spark, sf_dir, "documents"), min_documents=10, min_chars=1)


OP5_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), frequent AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(read_table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), digest_col="text_sha256")


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read_table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op11_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digests(read_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"), min_documents=10, top=10)


OP12_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs
), tokens AS (SELECT r, lang, source, unnest(terms) AS term FROM docs
), kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grid AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT lang, source, term, c,
           (1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v)) AS p,
           (1 + (1000000000::HUGEINT * (sum(c) OVER (PARTITION BY lang, term) + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v)) AS q
    FROM grid JOIN sizes USING (lang)
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
    UNION ALL
    SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    WHERE a.lang NOT IN (SELECT lang FROM sizes)
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q
), ranked AS (
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(conversations.damaged(read_table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_context_tree_scores": op3_context_tree_scores,
        "op4_quality": op4_quality,
        "op5_line_dedup": op5_line_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_token_counts": op8_token_counts,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_license_notices": op11_license_notices,
        "op12_source_divergence": op12_source_divergence,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op5_line_dedup": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op12_source_divergence": OP12_SQL}
