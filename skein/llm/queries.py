"""The queries of this subpackage, by the name under which they are registered."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, html_extract, jaccard_join, language_id, license_scan, mixing, mpeg_audio, pii, quality_gbdt, sharding


def queries() -> dict:
    return {"op1_mixing": mixing.op1_mixing, "op2_quality_gbdt": quality_gbdt.op2_quality_gbdt, "op3_decontaminate": decontaminate.op3_decontaminate, "op4_sharding": sharding.op4_sharding, "op5_html_extract": html_extract.op5_html_extract, "op6_license_scan": license_scan.op6_license_scan, "op7_pii": pii.op7_pii, "op8_mpeg_audio": mpeg_audio.op8_mpeg_audio, "op9_ngram_jaccard": jaccard_join.op9_ngram_jaccard, "op10_language_id": language_id.op10_language_id, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.op1_sql(), "op6_license_scan": license_scan.op6_sql(), "op9_ngram_jaccard": jaccard_join.op9_sql()}
