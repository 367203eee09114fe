"""Registered queries with the SQL that checks them."""

from catalog import cleaning, records, scoring, similarity, tokenizer

_SECTIONS = [cleaning, tokenizer, similarity, records, scoring]

QUERIES = {name: query for s in _SECTIONS for name, query in s.QUERIES.items()}
ORACLES = {name: sql for s in _SECTIONS for name, sql in s.ORACLES.items()}
