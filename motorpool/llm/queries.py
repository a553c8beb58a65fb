"""The operators bound to the source tables, with SQL where SQL states the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motorpool.llm import alignment, bpe, chat, contamination, exact, html, jaccard, license, near, periodic, pii, quality, urls
from motorpool.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_digest(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_digest(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_digest(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_digest(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES, public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_minhash_near_dedup,
        op3_exact_dedup,
        op4_url_filter,
        op5_license_scan,
        op6_chat_formatting,
        op7_decontamination,
        op8_byte_level_bpe,
        op9_html_extraction,
        op10_pii,
        op11_ngram_jaccard_join,
        op12_periodic_runs,
        op13_cross_tokenizer_alignment,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"[w for w in string_split_regex({_LOWER}, '[ \\t\\n\\x0B\\f\\r]+') if w <> '']"


def _shingles(name: str, source: str, key: str, k: int = 5) -> str:
    """CTEs: distinct k-word shingles of each text, and their number."""
    return f"""
        {name}_w AS (SELECT {key}, {_WORDS} AS ws FROM {source}),
        {name} AS (
            SELECT DISTINCT {key}, list_aggregate(list_slice(ws, i, i + {k - 1}), 'string_agg', ' ') AS shingle
            FROM (SELECT {key}, ws, unnest(range(1, greatest(1, len(ws) - {k - 1}) + 1)) AS i FROM {name}_w WHERE len(ws) > 0)),
        {name}_n AS (SELECT {key}, count(*) AS n FROM {name} GROUP BY {key})"""


def _components(k: int) -> str:
    """CTEs: the smallest document that links on k-word shingles reach, at 85 in a hundred."""
    return f"""{_shingles("s", "documents", "doc_id", k)},
        pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN s_n p ON p.doc_id = a JOIN s_n q ON q.doc_id = b
            WHERE 100 * common >= 85 * (p.n + q.n - common)),
        reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)"""


ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE {_components(5)}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN least USING (doc_id) LEFT JOIN s_n USING (doc_id)""",
    "op11_ngram_jaccard_join": f"""
        WITH RECURSIVE {_components(4)}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM documents JOIN least USING (doc_id) LEFT JOIN s_n USING (doc_id)""",
    "op6_chat_formatting": """
        WITH n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id
                ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT DISTINCT conv_id, role AS speaker FROM n WHERE role <> 'system'),
        v AS (
            SELECT conv_id, speaker, place // 256 AS part, place, coalesce(role = speaker, false) AS mine,
                CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                    ELSE '<|user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' END || chr(10) AS head,
                replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS rest
            FROM n JOIN p USING (conv_id)),
        o AS (
            SELECT *, head || rest AS segment,
                sum(length(head || rest)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place) - length(head || rest) AS began
            FROM v)
        SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(segment, '' ORDER BY place) AS text,
            coalesce(string_agg(CASE WHEN mine THEN (began + length(head))::BIGINT || '-' || (began + length(segment) - 1)::BIGINT END,
                ',' ORDER BY place), '') AS mask
        FROM o GROUP BY conv_id, speaker, part""",
    "op7_decontamination": f"""
        WITH {_shingles("d", "documents", "doc_id")}, {_shingles("i", "benchmark", "item_id")},
        shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY ALL)
        SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n AS containment
        FROM shared JOIN i_n USING (item_id) WHERE 100 * n_shared >= 80 * n""",
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
}
