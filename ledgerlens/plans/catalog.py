"""Imports every query module, so that QUERIES is complete."""

from ledgerlens.plans import q_checks, q_documents, q_layout, q_learning, q_sources, q_text  # noqa: F401
from ledgerlens.plans.registry import QUERIES

__all__ = ["QUERIES"]
