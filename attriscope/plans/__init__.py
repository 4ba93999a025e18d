from attriscope.plans.registry import ORACLE, QUERIES, entry_query

__all__ = ["QUERIES", "ORACLE", "entry_query"]
