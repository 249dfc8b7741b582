"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, fingerprint, html_extract, jaccard, lm_score, packing, pipeline, quality, sharding, substring, warc


def queries() -> dict:
    return {
        "op1_html_extraction": html_extract.op1,
        "op2_lm_scoring": lm_score.op2,
        "op3_benchmark_decontamination": decontaminate.op3,
        "op4_packing": packing.op4,
        "op5_quality_classifier": quality.op5,
        "op6_substring_dedup": substring.op6,
        "op7_sharding": sharding.op7,
        "op8_ngram_jaccard_join": jaccard.op8,
        "op9_document_fingerprints": fingerprint.op9,
        "op10_warc": warc.op10,
        "pipeline": pipeline.run,
    }


#: The other operators have no SQL that runs on whole tables; tests/llm holds them against brute force.
OP10 = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM sized),
decided AS (SELECT *, n >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS again FROM grouped)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to FROM decided
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10}
