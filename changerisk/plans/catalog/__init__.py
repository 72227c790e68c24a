"""Every operator as a query on the test tables, with the SQL that must give the same rows."""

from changerisk.plans.catalog import (  # noqa: F401
    aggregates,
    evaluation,
    history,
    learning,
    reduction,
    resumable,
    rows,
    samples,
    sources,
    vectors,
)
from changerisk.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
