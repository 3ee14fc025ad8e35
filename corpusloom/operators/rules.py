"""The rule engine: ordered (reason, predicate) pairs compiled to one expression, without any UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, Column]]


def all_reasons(rules: Rules) -> Column:
    """Array of the reasons that hold, in order; a null predicate does not hold."""
    return F.filter(F.array(*[F.when(p, F.lit(r)) for r, p in rules]), lambda x: x.isNotNull())


def first_reason(rules: Rules, otherwise: str) -> Column:
    """The first reason that holds, or `otherwise`."""
    return F.coalesce(*[F.when(p, F.lit(r)) for r, p in rules], F.lit(otherwise))
