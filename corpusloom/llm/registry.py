"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpusloom.llm import manifest, mixing, near, packing, quality, repeats, runs, secrets, sharding, syncmers, templates, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.query,
        "op2_suffix_dedup": repeats.query,
        "op3_packing": packing.query,
        "op4_sharding": sharding.query,
        "op5_quality_rules": quality.query,
        "op6_toxicity": toxicity.query,
        "op7_urls": urls.query,
        "op8_near_dedup": near.query,
        "op9_mixing": mixing.query,
        "op10_fingerprints": syncmers.query,
        "op11_html_text": templates.query,
        "op12_word_runs": runs.query,
        "op13_merkle_manifest": manifest.query,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    found = {"op8_near_dedup": near.SQL, "op9_mixing": mixing.SQL, "op13_merkle_manifest": manifest.SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
