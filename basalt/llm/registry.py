"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import decontamination, html, jaccard, language_model, lines, media, mixing, tokencount, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_media_columns": media.op4_media_columns,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_language_model": language_model.op7_language_model,
    "op8_token_counts": tokencount.op8_token_counts,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

SQL = {
    "op5_warc": warc.OP5_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
