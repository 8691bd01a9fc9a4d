"""Helpers that shape plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns that are computed once and that the optimizer can't copy into every place that uses them."""
    packed = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select("*", F.inline(packed))


def bound(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns made once: filters and branches that use them often would each make them again."""
    return df.select(*(c for c in df.columns if c not in names), F.inline(F.array(F.struct(*names)))).select(*df.columns)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to tasks by keys, all columns together: results that are made of it in several ways share one shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.array(F.struct(*rest)).alias("__row")).repartition(*keys).select(*keys, F.inline("__row"))


#: Rows that one task numbers.
NUMBERED_ROWS = 100_000


def numbered(df: DataFrame, name: str, start: int, key: str) -> DataFrame:
    """Append distinct numbers from start on, without gaps; in the order of key where one task is enough for all rows.

    More rows are numbered by hash bucket of the key, from the buckets' running totals, of which there are few.
    """
    n = max(1, -(-df.count() // NUMBERED_ROWS))
    df = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    totals = df.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    out = df.withColumn("__k", place).join(totals.select("__b", before.alias("__before")), "__b")
    return out.withColumn(name, (F.col("__k") + F.col("__before") + start).cast("bigint")).drop("__b", "__k", "__before")
