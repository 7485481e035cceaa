"""Relational operators: ingestion, notebooks, runs, registry, metrics, evaluation."""
