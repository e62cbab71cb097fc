"""All registered queries."""

from . import attribution, belief_queries, file_queries, flow_queries, mask_queries, place_queries  # noqa: F401
from .registry import ORACLES, PLANS  # noqa: F401
