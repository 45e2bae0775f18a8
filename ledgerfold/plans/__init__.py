"""The query catalogue: QUERIES and the SQL that says the same, ORACLES."""

from . import feeds, procedures, rest, store, transactions  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
