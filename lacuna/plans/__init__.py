"""Registered queries: one per operator, over tables derived from the given ones."""

from lacuna.plans import flagship, q_coding, q_evaluate, q_files, q_impute, q_prep, q_retrieve, q_splits, q_stats, q_trees, q_universals, q_vectors  # noqa: F401
from lacuna.plans.registry import ORACLES, QUERIES  # noqa: F401
