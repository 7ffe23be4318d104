"""Imports every module that registers queries."""

from ..streaming import process  # noqa: F401
from . import analytics, entity_queries, graph_queries, operator_queries, text_queries  # noqa: F401
