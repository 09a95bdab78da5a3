"""All queries of this subpackage, and their SQL where SQL can express them."""

from orrery.llm import chat, embedding_dedup, importance, infill, lexical, media, mixing, near_dedup, packing, rules, substring, token_counts, urls

MODULES = (chat, packing, near_dedup, substring, importance, token_counts, media, urls, mixing, rules, infill, embedding_dedup, lexical)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
