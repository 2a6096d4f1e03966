"""Fleet sensor analytics on Apache Spark.

Subpackages: ``sources`` (text, CSV, Parquet layout, ingest, file inventory), ``operators``
(warehouse queries, pipelines, jobs, reads and changes, model), ``functions`` (null-safe
expressions and skew-safe series helpers), ``plans`` (stored tables, query catalogue and its
DuckDB oracle), ``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
