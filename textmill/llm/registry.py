"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

import corpus_pipeline
from textmill.llm import licenses, spotsigs, suffixes
from textmill.llm.decontaminate import op8_decontaminate
from textmill.llm.html import op5_html
from textmill.llm.langid import op9_language_id
from textmill.llm.licenses import op6_licenses
from textmill.llm.mixing import op4_mixing
from textmill.llm.pii import op7_pii
from textmill.llm.simhash import op1_simhash
from textmill.llm.spotsigs import op2_spotsigs
from textmill.llm.suffixes import op3_repeats
from textmill.llm.toxicity import op10_toxicity
from textmill.shipping import shipping


QUERIES = [op1_simhash, op2_spotsigs, op3_repeats, op4_mixing, op5_html, op6_licenses, op7_pii, op8_decontaminate, op9_language_id, op10_toxicity]


def queries() -> dict:
    return {q.__name__: shipping(q) for q in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The others hash, classify or permute in ways that DuckDB has no functions for; tests/llm holds them against brute force."""
    return {"op2_spotsigs": spotsigs.oracle(), "op3_repeats": suffixes.ORACLE, "op6_licenses": licenses.oracle()}
