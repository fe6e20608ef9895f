"""Queries over the driver's tables, each an application of the library's operators."""

from . import audits, claims, documents, labels, names, pairs, reports, statistics, trajectories, vocabularies
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "claims", "documents", "labels", "names", "pairs", "reports", "statistics", "trajectories", "vocabularies"]
