"""The operators' queries, by name, and the SQL of those that SQL can express."""

from shorewise.llm import chat, decontaminate, fingerprint, language_id, lm_score, mixing, near_dedup, repeats, sharding, substrings, toxicity, variants, whitening

_MODULES = (language_id, decontaminate, toxicity, near_dedup, substrings, sharding, repeats, fingerprint, mixing, lm_score, whitening, chat, variants)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
