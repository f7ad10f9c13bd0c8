"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import align, decontaminate, divergence, html_text, line_dedup, near_dup, packing, quality_model, quality_rules, secrets, token_files, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_packing": packing.op4_packing,
    "op5_html_text": html_text.op5_html_text,
    "op6_warc": warc.op6_warc,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_token_files": token_files.op8_token_files,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_minhash": near_dup.op10_minhash,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_secret_scan": secrets.op13_secret_scan,
}

ORACLE_SQL = {
    "op3_url_filter": url_filter.SQL,
    "op6_warc": warc.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_minhash": near_dup.SQL,
    "op12_source_divergence": divergence.SQL,
}
