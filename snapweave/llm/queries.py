"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import (collocations, exact_dedup, html_text, lm_score, mixing, neighbours, packing, pii_scan, quality_rules, secret_scan,
               simhash, spelling, warc_index)

QUERIES = {
    "op1_temperature_mix": mixing.query,
    "op2_html_text": html_text.query,
    "op3_secret_scan": secret_scan.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_simhash": simhash.query,
    "op8_pii_scan": pii_scan.query,
    "op9_warc_index": warc_index.query,
    "op10_lm_score": lm_score.query,
    "op11_spelling_variants": spelling.query,
    "op12_collocations": collocations.query,
    "op13_nearest_neighbours": neighbours.query,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_temperature_mix": mixing.sql(),
        "op3_secret_scan": secret_scan.sql(),
        "op5_quality_rules": quality_rules.sql(),
        "op6_exact_dedup": exact_dedup.SQL,
        "op9_warc_index": warc_index.SQL,
        "op11_spelling_variants": spelling.SQL,
        "op12_collocations": collocations.SQL,
        "op13_nearest_neighbours": neighbours.SQL,
    }
