"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from platewise.llm import chat, encoding, language_id, line_dedup, minhash, packing, quality_rules, simhash, spelling, suffixes, topk, weak_labels, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(operator: Callable[..., DataFrame], *args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), *args)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": _documents(encoding.round_trip, VOCABULARY),
    "op2_quality_rules": _documents(quality_rules.quality_rules),
    "op3_packing": _documents(packing.packed, VOCABULARY),
    "op4_line_dedup": _documents(line_dedup.line_digest),
    "op5_quality_classifier": lambda spark, sf_dir: weak_labels.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_chat": lambda spark, sf_dir: chat.formatted_digest(table(spark, sf_dir, "conversations")),
    "op7_topk": lambda spark, sf_dir: topk.top_scores(table(spark, sf_dir, "embeddings")),
    "op8_language_id": _documents(language_id.identified),
    "op9_suffix_dedup": _documents(suffixes.removed_digest),
    "op10_minhash": _documents(minhash.components_digest),
    "op11_whitening": lambda spark, sf_dir: whitening.whitened(table(spark, sf_dir, "embeddings")),
    "op12_spelling": _documents(spelling.spelling_forms),
    "op13_simhash": _documents(simhash.near_duplicates),
}

LINES_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT doc_id, place, line, key IN (SELECT key FROM shared) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES: dict[str, str] = {
    "op4_line_dedup": LINES_SQL,
    "op6_chat": chat.FORMATTED_SQL,
    "op7_topk": topk.TOP_SQL,
}
