"""All registered queries of the library; importing the operators registers them."""

from .. import streaming  # noqa: F401
from ..operators import audits, corpus, evaluation, models, profile, relational, selection  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
