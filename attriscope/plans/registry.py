"""All registered queries (imported for their registration side effect)."""

from attriscope.plans import q_inferred, q_ml, q_profile, q_reports, q_resample, q_risk, q_sources, q_stream  # noqa: F401
from attriscope.plans.base import ORACLE, QUERIES


def entry_query():
    return QUERIES["department_profile"]


__all__ = ["QUERIES", "ORACLE", "entry_query"]
