"""Every query of the core library, by name, with its SQL."""

from ..operators import composite, curation, digests, discovery, edge_ledger, evaluation, evidence, globs, graph, ledger, ledgers, lexical_index, lint, prescriptions, probes, ranking, reminders, retrieval, similarity, succession, temporal

MODULES = (composite, curation, digests, discovery, edge_ledger, evaluation, evidence, globs, graph, ledger, ledgers, lexical_index, lint, prescriptions, probes, ranking, reminders, retrieval, similarity, succession, temporal)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
