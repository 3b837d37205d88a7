"""Queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from watchgrid.llm import alignment, collocations, jaccard_join, licenses, line_dedup, media, orc_ids, packing, quality_chain, quality_rules, sentencepieces, substring_dedup, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_quality_classifier": quality_chain.op2_quality_classifier,
        "op3_sentencepiece": sentencepieces.op3_sentencepiece,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_media_columns": media.op9_media_columns,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_orc_ids": orc_ids.op12_orc_ids,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op8_jaccard_join": jaccard_join.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
