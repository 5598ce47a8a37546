"""Named queries over the driver's tables."""

from . import events, library, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
