"""Queries of the training-data operators and their SQL."""

from . import bpe, collocations, decontaminate, html_text, licenses, lm_scores, media, secrets, simhash, spelling, substrings, token_counts, toxicity

MODULES = (bpe, collocations, decontaminate, html_text, licenses, lm_scores, media, secrets, simhash, spelling, substrings, token_counts, toxicity)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
