"""All queries of the adapter analytics, with their SQL."""

from . import decisions, keys, more, scans, vectors  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
