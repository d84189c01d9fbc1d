"""The query registry: every module here adds builders and their SQL."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import changes, core, functions, programs, relational  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
