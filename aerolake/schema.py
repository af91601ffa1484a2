"""The telemetry table and how its messages are read.

One row per logged record. Payload lives in three maps (integers, reals, texts), so logs that
disagree on a message's columns share one table, a missing column is a missing key, and
reading several columns of a record needs no pivot. Missing readings are NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TELEMETRY = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("instance", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("ints", T.MapType(T.StringType(), T.LongType())),
    T.StructField("reals", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("texts", T.MapType(T.StringType(), T.StringType())),
])
KEY = ["log_id"]


def has_number(name: str) -> Column:
    return F.coalesce(F.map_contains_key("reals", F.lit(name)), F.lit(False)) | F.coalesce(
        F.map_contains_key("ints", F.lit(name)), F.lit(False))


def has_text(name: str) -> Column:
    return F.coalesce(F.map_contains_key("texts", F.lit(name)), F.lit(False))


def number(*names: str) -> Column:
    """The reading under the first of several spellings that the record has, as a double.

    A spelling counts if its key is there: a NULL under it stays NULL and no later spelling is asked.
    """
    chosen = F.lit(None).cast("double")
    for n in reversed(names):
        reading = F.coalesce(F.col("reals")[n], F.col("ints")[n].cast("double"))
        chosen = F.when(has_number(n), reading).otherwise(chosen) if len(names) > 1 else reading
    return chosen


def any_number(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [has_number(n) for n in names])


def text(*names: str) -> Column:
    chosen = F.lit(None).cast("string")
    for n in reversed(names):
        chosen = F.when(has_text(n), F.col("texts")[n]).otherwise(chosen) if len(names) > 1 else F.col("texts")[n]
    return chosen


def records(telemetry: DataFrame, *msgs: str) -> DataFrame:
    """Records of some messages; on a table partitioned by ``msg`` only their files are read."""
    return telemetry.where(F.col("msg").isin(*msgs))


def plain(telemetry: DataFrame, msg: str) -> DataFrame:
    """Records of a message that carries no instance number."""
    return telemetry.where((F.col("msg") == msg) & F.col("instance").isNull())


@dataclass(frozen=True)
class Source:
    """A candidate origin of a value: message, instance (None = no instance), column, sign."""

    msg: str
    instance: int | None
    column: str
    sign: float = 1.0

    @property
    def key(self) -> str:
        return self.msg if self.instance is None else f"{self.msg}[{self.instance}]"

    def matches(self) -> Column:
        same = F.col("instance").isNull() if self.instance is None else (
            F.col("instance") == self.instance)
        return (F.col("msg") == self.msg) & F.coalesce(same, F.lit(False)) & has_number(self.column)

    def value(self) -> Column:
        return number(self.column) * F.lit(self.sign) if self.sign != 1.0 else number(self.column)


def best_source(telemetry: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """(log_id, rank) of the first candidate each log has: one partial aggregate."""
    first = F.lit(None).cast("int")
    for rank in reversed(range(len(sources))):
        first = F.when(sources[rank].matches(), F.lit(rank)).otherwise(first)
    rows = records(telemetry, *{s.msg for s in sources})
    return rows.groupBy(*KEY).agg(F.min(first).alias("rank")).where(F.col("rank").isNotNull())


def first_source(telemetry: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """(log_id, seq, t, value, source) from the first candidate each log has."""
    best = best_source(telemetry, sources).withColumnRenamed("log_id", "_log")
    rows = records(telemetry, *{s.msg for s in sources})
    rows = rows.join(best, F.col("log_id") == F.col("_log"), "inner")
    chosen, value, label = F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("string")
    for rank, source in enumerate(sources):
        mine = F.col("rank") == rank
        chosen = F.when(mine, source.matches()).otherwise(chosen)
        value = F.when(mine, source.value()).otherwise(value)
        sign = "-" if source.sign < 0 else ""
        label = F.when(mine, F.lit(f"{source.key}.{sign}{source.column}")).otherwise(label)
    return rows.where(chosen).select(*KEY, "seq", "t", value.alias("value"), label.alias("source"))


def signals(telemetry: DataFrame) -> DataFrame:
    """Long numeric form: one row per record and numeric column."""
    ints = F.transform_values("ints", lambda _, v: v.cast("double"))
    return telemetry.select(
        *KEY, "msg", "instance", "seq", "t",
        F.explode(F.map_concat(F.coalesce("reals", F.create_map().cast("map<string,double>")),
                               F.coalesce(ints, F.create_map().cast("map<string,double>"))))
        .alias("col", "value"))
