"""Scores of ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_rank_score(rank: Column, total: int) -> Column:
    """1 for the first of ``total`` ranks, falling evenly; null for a null rank."""
    return (F.lit(total) - rank + 1) / F.lit(float(total))


def reciprocal_rank_score(rank: Column) -> Column:
    return F.round(1.0 / rank, 4)
