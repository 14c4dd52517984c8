"""Every registered query, with the SQL that checks it where SQL can say it."""

from sievelight.plans import bursts, copies, metadata, sidecars, stores, streams, text, views  # noqa: F401
from sievelight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
