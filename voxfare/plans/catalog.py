"""All registered queries."""

from __future__ import annotations

from voxfare.plans import q_models, q_parts, q_stats, q_streams, q_summaries, q_text  # noqa: F401
from voxfare.plans.registry import ORACLES, QUERIES, Plan


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
