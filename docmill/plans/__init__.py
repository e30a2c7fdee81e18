"""Queries over the tables: importing this package registers them."""

from docmill.plans import analytics, answers, checks, entities, formats, graphs, patterns, pipes, questions, relations, scalars, search, streams  # noqa: F401
from docmill.plans.registry import ORACLE, QUERIES  # noqa: F401
