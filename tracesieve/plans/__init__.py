"""Registered queries. Importing this package fills the registry."""
from tracesieve.plans.registry import ORACLES, QUERIES, Tables
from tracesieve.plans import diagnostics, dataset, review, evaluation, events, code, pairs, learn  # noqa: F401

__all__ = ["ORACLES", "QUERIES", "Tables"]
