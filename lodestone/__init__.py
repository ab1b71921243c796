"""Lodestone: code retrieval, routing and ledger analytics as Spark DataFrame operators."""
