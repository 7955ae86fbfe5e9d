"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters may test.

    A filter on a plain computed column is pushed below the projection together with a second
    copy of the expression.  The one-element explode keeps it above, so the value is computed
    once per row.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))
