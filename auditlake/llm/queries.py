"""The registered opN queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .warc import capture_histories

    found = capture_histories(_table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, {1 + 5 * (i // 4)}, 5))::BIGINT // {32 ** (3 - i % 4)}) % 32 AS INTEGER), 1)" for i in range(32)
)
OP2_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM g
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op4_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import removed_passages

    return removed_passages(_table(spark, sf_dir, "documents"))


def op6_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rff import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import store_texts

    return store_texts(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op9_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_span_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_boosted_rules, op2_warc_merge, op3_packing, op4_clause_grammar, op5_suffix_passages, op6_fourier_quality, op7_matroska, op8_byte_bpe, op9_prefix_jaccard, op10_span_tagger]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_merge": OP2_SQL}
