"""Vectors out of tables: which are usable, and blocks of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(embedding: Column) -> Column:
    return embedding.cast("array<double>")


def usable(embedding: Column) -> Column:
    """Not null, not empty, and every component a finite number; for columns of array<double>."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.lit(False))
