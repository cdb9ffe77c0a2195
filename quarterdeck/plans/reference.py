"""All queries of the panel, rating, evaluation and model operators."""

from . import logs, modelling, panels, pipelines  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
