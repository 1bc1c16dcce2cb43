"""All registered queries."""

from nlcorpus.plans import (catalog_clean, catalog_dialogue, catalog_encode, catalog_evaluate, catalog_profile,
                            catalog_sources, catalog_trees)  # noqa: F401
from nlcorpus.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
