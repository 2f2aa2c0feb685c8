"""The registered queries of this subpackage, and the SQL of the one that the checking engine can express.

The others need XXH64, least audits, suffix orders, trained models, tokenizer files, HTML parsing or schedules; tests
compare each with a brute-force version or a library instead.
"""

from . import ann, conversations, embedding_dedup, html_text, language_id, merkle, mixing, sentencepiece_lattice, sharding, simhash, suffix_dedup, token_counts, toxicity

MODULES = (language_id, ann, token_counts, toxicity, mixing, html_text, simhash, embedding_dedup, sentencepiece_lattice, sharding, conversations, merkle, suffix_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return dict(merkle.ORACLE)
