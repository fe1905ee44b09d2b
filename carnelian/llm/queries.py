"""The queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from carnelian.llm import decontaminate, language, licenses, mixing, near_duplicates, quality_classifier, quality_rules, secrets, token_counts, toxicity

_MODULES = (near_duplicates, toxicity, licenses, mixing, decontaminate, secrets, quality_rules, quality_classifier, token_counts, language)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
