"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import alignment, decontaminate, language, line_dedup, mixing, mixing_lm, quality, quality_rules, ranked_search, secrets, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_mixing_lm": mixing_lm.op7_mixing_lm,
    "op8_language": language.op8_language,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_mixing": mixing.op10_mixing,
    "op11_alignment": alignment.op11_alignment,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op9_secret_scan": secrets.ORACLE,
    "op12_suffix_dedup": suffix_dedup.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
