"""Operators for text corpora: duplicates, scores, extraction, contamination, licences, languages, packing."""

from sparktide.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
