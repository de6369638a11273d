"""Runnable queries of every operator, each with an SQL twin where SQL can say it."""

from .base import ORACLE, QUERIES
from . import cleaning, deriving, profiling, evaluating, extracting, modelling, storing, growing

__all__ = ["ORACLE", "QUERIES"]
