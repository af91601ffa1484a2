"""Columns that an operator adds, and columns of its input that bear the same names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add: its own columns replace them."""
    clashing = [c for c in names if c in df.columns]
    return df.drop(*clashing) if clashing else df


def shielded(df: DataFrame, used: Iterable[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on ``df`` with all columns but ``used`` under neutral names, and its rows under the old names.

    For operators that return the columns of their input: whatever names they use inside, no column of the
    input can meet them.
    """
    used = set(used)
    names = {c: c if c in used else f"other_{i}" for i, c in enumerate(df.columns)}
    result = run(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return result.select(*[F.col(n).alias(c) for c, n in names.items()])
