"""All queries of this subpackage."""

from riskfeat.llm import plans  # noqa: F401
from riskfeat.llm.base import BOOK

__all__ = ["BOOK"]
