"""Rows that stand for several equal ones, as so many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies that one task makes of a row at most.
COPIES = 1 << 14


def numbered(rows: DataFrame, copies: str, number: str) -> DataFrame:
    """Each row as often as ``copies`` says, with a ``number`` from 0.  A row with
    very many is dealt in parts to all tasks first; rows should be settled, as
    they are read twice."""
    n, sizes = F.col(f"`{copies}`"), F.lit(COPIES).cast("long")
    few = rows.where(n <= COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias(number))
    parts = rows.where(n > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES))).alias("copies_part"))
    first = F.col("copies_part") * sizes
    many = parts.repartition("copies_part", *rows.columns).select("*", F.explode(F.sequence(first, F.least(first + sizes, n) - 1)).alias(number)).drop("copies_part")
    return few.unionByName(many)
