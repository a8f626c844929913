"""Name -> query of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, conversations, decontaminate, html_text, langid, lm_score, near_dedup, periodic_runs, pii, quality, sharding, token_counts, url_filter

QUERIES = {
    "op1_urls": url_filter.op1_urls,
    "op2_pii": pii.op2_pii,
    "op3_html": html_text.op3_html,
    "op4_lm": lm_score.op4_lm,
    "op5_bpe": bpe.op5_bpe,
    "op6_langid": langid.op6_langid,
    "op7_winnowing": decontaminate.op7_winnowing,
    "op8_simhash": near_dedup.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_slots": sharding.op10_slots,
    "op11_repair": conversations.op11_repair,
    "op12_runs": periodic_runs.op12_runs,
    "op13_prefix_counts": token_counts.op13_prefix_counts,
}
ORACLES: dict[str, str] = {"op4_lm": lm_score.ORACLE, "op7_winnowing": decontaminate.ORACLE}
