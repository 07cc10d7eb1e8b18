"""Named queries over the supplied tables, each next to the SQL it must agree with."""

from quillsift.plans.catalog.registry import ORACLES, QUERIES
from quillsift.plans.catalog import collection, data_set, evaluation, features, model_runs, texts  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
