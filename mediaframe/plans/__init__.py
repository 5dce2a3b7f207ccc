"""Registered queries: each is a Spark plan over the given tables plus, where SQL can say it, the same in SQL."""

from mediaframe.plans import blocks_q, container_q, diff_q, motion_q, profile_q, source_q, streaming_q, trace_q, udf_q  # noqa: F401
from mediaframe.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
