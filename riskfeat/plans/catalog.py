"""All registered queries."""

from riskfeat.plans import binning, columns, joins, models, prepare, rows, stats, text, transactions  # noqa: F401
from riskfeat.plans.base import BOOK

__all__ = ["BOOK"]
