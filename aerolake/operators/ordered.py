"""Row-order operators (previous, next, fill, position, running totals) that survive hot keys.

Within a fleet one log may hold a third of all rows, so ``Window.partitionBy(log_id)`` alone
would put that third into one task. ``Ordered`` measures the largest key first:

* every key fits one task: plain window functions, one exchange on the key;
* some key does not: hot keys are cut into time pieces, the windows run per (key, piece), and
  a small table with one row per piece carries the values across the piece borders.

Both ways give the same rows; tests force the second one on small data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.session import cut, rows_per_task

_PIECES = ("_cell", "_sub", "_deep")
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join that also matches NULL keys; the right copies of the keys are dropped."""
    renamed = right
    condition = F.lit(True)
    for name in on:
        renamed = renamed.withColumnRenamed(name, f"_r_{name}")
        condition = condition & F.col(name).eqNullSafe(F.col(f"_r_{name}"))
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{name}" for name in on])


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key: partial counts per task, one number to the driver."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


#: A task orders this many bytes for every row it may hold, in memory or spilled.
ROW_BYTES = 16


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; starts no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def needs_split(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some key has too many rows for a task. Only tables that are large as planned are counted: a
    small one fits a task whatever its keys are. Both plans give the same rows."""
    limit = rows_per_task(df.sparkSession)
    return planned_bytes(df) > limit * ROW_BYTES and largest_key(df, keys) > limit


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with more rows than a task may hold: at most one row per ``rows_per_task`` input rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_h_n"))
    return cut(counts.where(F.col("_h_n") > rows_per_task(df.sparkSession)).select(*keys))


def _split_once(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: Sequence[str], number: str, limit: int) -> DataFrame:
    """Cut every piece of more than ``limit`` rows by the first order column that varies in it.

    Rows where that column is NULL come first and get a number of their own, -1; the other rows of the
    piece are cut evenly in the column. A column that is no number cannot be cut, so its piece stays.
    """
    task = rows_per_task(df.sparkSession)
    facts = [F.count(F.lit(1)).alias("_h_n")]
    for i, c in enumerate(order):
        facts += [F.min(c).alias(f"_h_lo{i}"), F.max(c).alias(f"_h_hi{i}"), F.count(c).alias(f"_h_c{i}")]
    crowded = df.groupBy(*keys, *pieces).agg(*facts).where(F.col("_h_n") > limit).withColumn("_h_pieces", F.ceil(F.col("_h_n") / task))
    part = F.lit(0)
    for i, c in reversed(list(enumerate(order))):
        low, high = F.col(f"_h_lo{i}"), F.col(f"_h_hi{i}")
        varies = (low < high) | ((F.col(f"_h_c{i}") > 0) & (F.col(f"_h_c{i}") < F.col("_h_n")))
        inside = F.lit(0)
        if _numeric(df, c):
            x = F.col(c).cast("double")
            share = (x - low.cast("double")) / (high.cast("double") - low.cast("double"))
            even = F.when(low.cast("double") < high.cast("double"), F.least(F.floor(share * F.col("_h_pieces")), F.col("_h_pieces") - 1)).otherwise(F.lit(0))
            inside = F.when(F.col(c).isNull(), F.lit(-1)).otherwise(even)
        part = F.when(F.coalesce(varies, F.lit(False)), inside).otherwise(part)
    found = null_safe_join(df, F.broadcast(crowded), [*keys, *pieces], "left")
    return found.withColumn(number, F.coalesce(F.when(F.col("_h_n").isNotNull(), part), F.lit(0)).cast("bigint")).drop(
        *[c for c in crowded.columns if c.startswith("_h_")])


def split_hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the pieces of hot keys in ``_cell``, ``_sub`` and ``_deep`` (all 0 elsewhere).

    A hot key is cut evenly in time; a piece that is still hot is cut again by time, or by the next order
    column where all its rows carry one time, and so on. The tables that are joined back hold at most one
    row per ``rows_per_task`` input rows, which bounds the broadcasts.
    """
    limit = rows_per_task(df.sparkSession)
    for depth, name in enumerate(_PIECES):
        df = _split_once(df, keys, order, _PIECES[:depth], name, limit if depth == 0 else 2 * limit)
    return df


class Ordered:
    """Rows of ``df`` per key in ascending ``order`` (time first, then tie breakers).

    If some key is hot, only the hot keys take the split plan; all others keep the plain one.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 split: bool | None = None):
        self.keys, self.order = list(keys), list(order)
        self.split = needs_split(df, keys) if split is None else split
        self.df = df
        if self.split:
            hot = hot_keys(df, keys)
            self.df = null_safe_join(df, F.broadcast(hot), self.keys, "left_anti")
            self.hot = cut(split_hot_keys(null_safe_join(df, F.broadcast(hot), self.keys, "left_semi"), self.keys, self.order))

    def add(self, prev: Mapping[str, Column] | None = None,
            next: Mapping[str, Column] | None = None,
            last: Mapping[str, Column] | None = None,
            following: Mapping[str, Column] | None = None,
            position: str | None = None,
            running: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
        """Add columns computed in row order.

        prev / next: the expression on the neighbouring row. last / following: the nearest
        non-NULL value at or before / at or after the row. position: 1-based row number.
        running: ``("sum" | "max" | "min", expression)`` from the first row to this one.
        """
        parts = (prev or {}, next or {}, last or {}, following or {}, position, running or {})
        plain = self._plain(*parts)
        return plain.unionByName(self._split(*parts)) if self.split else plain

    def _windows(self, keys: Sequence[str]):
        up = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in self.order])
        down = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        return up, down

    def _plain(self, prev, next, last, following, position, running) -> DataFrame:
        up, down = self._windows(self.keys)
        so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {}
        for name, expr in prev.items():
            columns[name] = F.lag(expr).over(up)
        for name, expr in next.items():
            columns[name] = F.lead(expr).over(up)
        for name, expr in last.items():
            columns[name] = F.last(expr, ignorenulls=True).over(so_far)
        for name, expr in following.items():
            columns[name] = F.last(expr, ignorenulls=True).over(ahead)
        if position:
            columns[position] = F.row_number().over(up).cast("bigint")
        for name, (how, expr) in running.items():
            columns[name] = _MERGE[how](expr).over(so_far)
        return self.df.withColumns(columns)

    def _split(self, prev, next, last, following, position, running) -> DataFrame:
        pieces = [*self.keys, *_PIECES]
        up, down = self._windows(pieces)
        so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rank = F.struct(*[F.col(c) for c in self.order])

        # One row per piece: what its neighbours need to know about it.
        edges = [F.count(F.lit(1)).alias("_rows")]
        edges += [F.max_by(F.struct(e.alias("v")), rank).alias(f"_p_{n}") for n, e in prev.items()]
        edges += [F.min_by(F.struct(e.alias("v")), rank).alias(f"_n_{n}") for n, e in next.items()]
        edges += [F.max_by(e, F.when(e.isNotNull(), rank)).alias(f"_l_{n}") for n, e in last.items()]
        edges += [F.min_by(e, F.when(e.isNotNull(), rank)).alias(f"_f_{n}")
                  for n, e in following.items()]
        edges += [_MERGE[how](e).alias(f"_r_{n}") for n, (how, e) in running.items()]
        table = self.hot.groupBy(*pieces).agg(*edges)

        forward = Window.partitionBy(*self.keys).orderBy(*_PIECES)
        backward = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in _PIECES])
        before = forward.rowsBetween(Window.unboundedPreceding, -1)
        after = backward.rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.sum("_rows").over(before).alias("_c_rows")]
        carried += [F.lag(f"_p_{n}").over(forward).alias(f"_c_{n}") for n in prev]
        carried += [F.lead(f"_n_{n}").over(forward).alias(f"_c_{n}") for n in next]
        carried += [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last]
        carried += [F.last(f"_f_{n}", ignorenulls=True).over(after).alias(f"_c_{n}")
                    for n in following]
        carried += [_MERGE[how](f"_r_{n}").over(before).alias(f"_c_{n}")
                    for n, (how, _) in running.items()]
        table = table.select(*pieces, *carried)

        local = {"_at": F.row_number().over(up), "_ends": F.lead(F.lit(1)).over(up).isNull()}
        local |= {n: F.lag(e).over(up) for n, e in prev.items()}
        local |= {n: F.lead(e).over(up) for n, e in next.items()}
        local |= {n: F.last(e, ignorenulls=True).over(so_far) for n, e in last.items()}
        local |= {n: F.last(e, ignorenulls=True).over(ahead) for n, e in following.items()}
        local |= {n: _MERGE[how](e).over(so_far) for n, (how, e) in running.items()}
        rows = null_safe_join(self.hot.withColumns(local), table, pieces, "left")

        columns = {}
        for name in prev:
            columns[name] = F.when(F.col("_at") == 1, F.col(f"_c_{name}.v")).otherwise(F.col(name))
        for name in next:
            columns[name] = F.when(F.col("_ends"), F.col(f"_c_{name}.v")).otherwise(F.col(name))
        for name in [*last, *following]:
            columns[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))
        if position:
            columns[position] = (F.coalesce(F.col("_c_rows"), F.lit(0)) + F.col("_at")).cast("bigint")
        for name, (how, _) in running.items():
            mine, carry = F.col(name), F.col(f"_c_{name}")
            if how == "sum":
                columns[name] = F.when(mine.isNull(), carry).otherwise(
                    mine + F.coalesce(carry, F.lit(0)))
            else:
                columns[name] = (F.greatest if how == "max" else F.least)(mine, carry)
        rows = rows.withColumns(columns)
        helpers = [c for c in rows.columns if c.startswith("_c_")]
        return rows.drop(*helpers, *_PIECES, "_at", "_ends")
