"""Queries of the corpus operators, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import (
    chat,
    decontaminate,
    language_id,
    licenses,
    line_dedup,
    packing,
    quality,
    ranked_search,
    secrets,
    simhash_dedup,
    substring_dedup,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffix_array_dedup": substring_dedup.op4_suffix_array_dedup,
    "op5_simhash_near_dedup": simhash_dedup.op5_simhash_near_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_language_id": language_id.op12_language_id,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op6_chat_format": chat.OP6_SQL, "op7_line_dedup": line_dedup.OP7_SQL, "op11_ranked_search": ranked_search.OP11_SQL}
