"""Acceptance queries: every operator on the driver's tables, each with an independent SQL text."""

from .registry import CASES
from . import census, climate, fieldwork, relational, sources, statistics  # noqa: F401  (register their queries)

__all__ = ["CASES"]
