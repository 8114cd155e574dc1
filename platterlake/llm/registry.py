"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from . import byte_bpe, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality_bayes, quality_rules, suffix_dedup, telephony

_MODULES = (telephony, mixing, lm_scoring, suffix_dedup, near_dedup, line_dedup, language_id, quality_bayes, quality_rules, byte_bpe)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
