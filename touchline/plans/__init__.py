"""The catalogue of queries; importing the modules fills it."""

from . import backtest, linking, match, records, tables  # noqa: F401
from .base import CATALOG, VIEWS

__all__ = ["CATALOG", "VIEWS"]
