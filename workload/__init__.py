"""Registered queries: every operator run over whole tables, with SQL that computes the same."""

from workload import alerting, deriving, exporting, scalars, scoring, selecting, sourcing, storing, streams  # noqa: F401
from workload.inputs import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
