"""tabsight: evidence-driven tabular analytics expressed as Spark DataFrame jobs.

Every operator is a function ``DataFrame (+ params) -> DataFrame``; results are
tables (long format), never nested driver-side dictionaries.

Sub-packages
------------
``sources``    readers, file manifests, catalog sinks
``functions``  column expressions (dates, safe ratios, moments, name rules)
``operators``  statistics, quality/leakage audit, features, split, metrics,
               models, explainability, critic, evidence tables, guarded SQL
``plans``      composite jobs (full profile, end-to-end run, benchmark sweep)
               and the registry of checked queries
``streaming``  incremental dataset registration from a landing folder
"""

from tabsight.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
