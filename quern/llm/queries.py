"""Queries of the training-data operators and the SQL that DuckDB checks them with, where SQL can say it."""

from __future__ import annotations

import corpus_pipeline

from . import decontamination, html_text, language, licences, packing, pii, quality, simhash, substrings, warc

QUERIES = {
    "op1_html_extraction": html_text.query,
    "op2_substring_dedup": substrings.query,
    "op3_licence_scan": licences.query,
    "op4_personal_data": pii.query,
    "op5_decontamination": decontamination.query,
    "op6_simhash": simhash.query,
    "op7_warc": warc.query,
    "op8_packing": packing.query,
    "op9_language_id": language.query,
    "op10_quality_rules": quality.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_substring_dedup": substrings.ORACLE,
    "op3_licence_scan": licences.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op7_warc": warc.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
