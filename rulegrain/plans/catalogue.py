"""Imports every module that registers queries."""

from rulegrain.plans import scalar_queries  # noqa: F401
from rulegrain.plans import quality_queries  # noqa: F401
from rulegrain.plans import change_queries  # noqa: F401
from rulegrain.plans import evidence_queries  # noqa: F401
from rulegrain.plans import ingest_queries  # noqa: F401
from rulegrain.plans import directory_queries  # noqa: F401
from rulegrain.plans import stateful_queries  # noqa: F401
from rulegrain.plans import eligibility_queries  # noqa: F401
from rulegrain.plans.registry import ORACLES, PLANS  # noqa: F401
