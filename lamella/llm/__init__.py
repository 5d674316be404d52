"""Operators for large training-data pipelines. Nothing outside this folder imports it."""

from __future__ import annotations

from . import decontaminate, jaccard, knn, licenses, lines, lm_score, mixing, recompress, suffix_array, toxicity

MODULES = (licenses, lm_score, mixing, lines, recompress, toxicity, jaccard, suffix_array, knn, decontaminate)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
