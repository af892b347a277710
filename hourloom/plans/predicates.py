"""Building filters from optional parts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

def all_of(predicates) -> Column:
    """AND of the given predicates, skipping None; true when there are none."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def relevance(relevant: bool | int | None) -> Column | None:
    """Work-log relevance: true keeps current projects, false keeps finished ones."""
    if relevant is None:
        return None
    return F.col("isDone") == (0 if relevant else 1)
