"""The measuring bench: its queries and their SQL."""

from trackmeter.plans import bench_oracles, bench_queries, planted_oracles, planted_queries, report_oracles, report_queries

QUERIES = bench_queries.QUERIES | report_queries.QUERIES | planted_queries.QUERIES
ORACLES = bench_oracles.ORACLES | report_oracles.ORACLES | planted_oracles.ORACLES

__all__ = ["ORACLES", "QUERIES"]
