"""The numbered corpus queries, the pipeline and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, katz, langid, lines, mixing, quality, resample, simhash, spelling, substrings, suffixes, urls


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "quality_policies": quality.quality_policies,
        "quality_ablation": quality.quality_ablation,
        "op2_katz_backoff": katz.op2_katz_backoff,
        "op3_simhash_components": simhash.op3_simhash_components,
        "op4_curriculum_mix": mixing.op4_curriculum_mix,
        "op5_substring_dedup": substrings.op5_substring_dedup,
        "op6_anisotropic_search": ann.op6_anisotropic_search,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_cross_parsing": langid.op8_cross_parsing,
        "op9_suffix_dedup": suffixes.op9_suffix_dedup,
        "op10_line_chunks": lines.op10_line_chunks,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_url_rules": urls.op12_url_rules,
        "op13_importance_resampling": resample.op13_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "quality_policies": quality.POLICIES_SQL,
        "quality_ablation": quality.ABLATION_SQL,
        "op4_curriculum_mix": mixing.OP4_SQL,
        "op5_substring_dedup": substrings.OP5_SQL,
        "op6_anisotropic_search": ann.OP6_SQL,
        "op9_suffix_dedup": suffixes.OP9_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_url_rules": urls.OP12_SQL,
        "op13_importance_resampling": resample.OP13_SQL,
    }
