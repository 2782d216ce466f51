"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, jaccard_join, language_id, lexical_search, line_dedup, nearest, periodic_runs, pii, quality, toxicity, url_filter


def queries():
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_pii": pii.op4_pii,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_url_filter": url_filter.op6_url_filter,
        "op8_language_id": language_id.op8_language_id,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_nearest": nearest.op12_nearest,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql():
    return {
        "op6_url_filter": url_filter.OP6_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op9_decontamination": decontaminate.OP9_SQL,
        "op10_ngram_jaccard_join": jaccard_join.OP10_SQL,
    }
