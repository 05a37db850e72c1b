"""Registers the queries of this folder: each applies one operator, with its production parameters,
to its whole table."""

from __future__ import annotations

from rulegrain.llm import mining_queries, structure_queries, training_queries  # noqa: F401
from rulegrain.llm.registry import ORACLES, PLANS  # noqa: F401
