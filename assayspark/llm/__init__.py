"""Operators for preparing training corpora; nothing else in the library imports this package."""

from assayspark.llm import (  # noqa: F401
    decontaminate,
    filter_audit,
    html_text,
    importance,
    language_id,
    license_scan,
    near_duplicates,
    packing,
    pii,
    quality_model,
    quality_rules,
    token_counts,
    url_filter,
)
from assayspark.llm.shared import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
