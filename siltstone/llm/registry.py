"""The training-data queries and their SQL."""

from __future__ import annotations

from siltstone.llm import decontaminate, html_extract, language_id, near_dedup, packing, quality, secrets, token_counts, topk, toxicity


def pipeline(spark, sf_dir: str):
    """run() of corpus_pipeline.py at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": language_id.query,
    "op2_html_extraction": html_extract.query,
    "op3_toxicity": toxicity.query,
    "op4_packing": packing.query,
    "op5_quality": quality.query,
    "op6_secret_scan": secrets.query,
    "op7_exact_topk": topk.query,
    "op8_decontamination": decontaminate.query,
    "op9_token_counts": token_counts.query,
    "op10_near_dedup": near_dedup.query,
    "proximity_matches": decontaminate.proximity_query,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_topk": topk.SQL,
    "op8_decontamination": decontaminate.SQL,
}
