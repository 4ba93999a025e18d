"""attriscope: workforce-attrition analytics expressed as Spark DataFrame / SQL plans.

Sub-packages
------------
sources    table loading, the employee stand-in view, CSV / table / model sinks
functions  column expressions (finance, right-closed bands, rule texts, scorer)
operators  DataFrame operators and reports (profile, risk, scenario, k-NN, ML ...)
plans      the query registry used by ``__spark_entry__`` and its DuckDB oracle
streaming  incremental scoring of roster files (file source, available-now)
"""

__version__ = "0.1.0"
