"""Queries over the driver's tables; importing the package registers them in the catalog."""

from . import backfill, comparison, documents, evaluation, evidence, graphs, items, jobs, merging, more, notation, recovery, relational, retrieval, scalars, searches, significance, tracks, vocabularies  # noqa: F401
