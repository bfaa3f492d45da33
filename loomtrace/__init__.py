"""Routing-connectivity analytics for hierarchical grid layouts, on Spark DataFrames.

The four entry points each take the path of a runset YAML file; every stage is a
prefix of the next one: ``load_db`` -> ``flatten`` -> ``merge_vector`` -> ``run_lvs``.
"""

from loomtrace.plans.pipeline import flatten, load_db, merge_vector, run_lvs

# The stages in camel case, for callers who prefer it.
runLVS = run_lvs
loadDB = load_db
mergeVector = merge_vector

__all__ = ["run_lvs", "load_db", "flatten", "merge_vector", "runLVS", "loadDB", "mergeVector"]
