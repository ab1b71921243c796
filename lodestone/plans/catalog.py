"""All registered queries and their SQL counterparts, without the ``llm`` subpackage."""

from __future__ import annotations

from lodestone.plans import hybrid, integrity, ledgers, retrieval, storage

FLAGSHIP = "retrieve_topk"
MODULES = (integrity, retrieval, hybrid, ledgers, storage)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
