"""The k-th smallest of a column, by counting passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, STEP = 60, 12
#: Values that are sorted on the driver at the end.
FEW = 4096


def hash_of(*keys: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed and keys: the same in any SQL engine (:func:`hash_sql`)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def hash_sql(*keys: str, seed: int) -> str:
    """:func:`hash_of` in DuckDB SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({k} AS VARCHAR), 'null')" for k in keys]])
    return f"CAST('0x' || substr(md5({text}), 1, {BITS // 4}) AS BIGINT)"


def kth_smallest(df: DataFrame, value: Column, k: int) -> tuple[int, int] | None:
    """The ``k``-th smallest value (from 1) and how many of the rows that have it belong to the first ``k``.

    ``value`` lies in [0, 2^60); nulls don't count.  Each pass counts rows by the next 12 bits of
    the values that share the prefix found so far (at most 4,096 counts reach
    the driver); the rows are never sorted.  None if there are fewer than ``k`` rows.
    """
    if k < 1:
        return None
    rows, prefix, known = df.select(value.alias("v")).where("v is not null"), 0, 0
    while known < BITS:
        shift = BITS - known - STEP
        here = rows.where(F.shiftright("v", shift + STEP) == prefix) if known else rows
        digit = F.shiftright("v", shift).bitwiseAND((1 << STEP) - 1)
        for r in sorted(here.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.d):
            if k <= r.n:
                prefix, known, left = prefix << STEP | r.d, known + STEP, r.n
                break
            k -= r.n
        else:
            return None
        if known < BITS and left <= FEW:
            last = sorted(r.v for r in rows.where(F.shiftright("v", BITS - known) == prefix).collect())
            return last[k - 1], k - last.index(last[k - 1])
    return prefix, k


def first_k(df: DataFrame, value: Column, k: int, ties: list[Column], column: str = "_first") -> DataFrame:
    """Adds whether a row is among the ``k`` with the smallest values; equal values go by ``ties``.

    Rows at the last value are numbered over as many partitions as they need.
    """
    from .ordering import grouped_row_number
    found = kth_smallest(df, value, k)
    if found is None:
        return df.withColumn(column, F.lit(k > 0))
    last, among = found
    at = df.where(value == last)
    if at.count() == among:
        return df.withColumn(column, F.coalesce(value <= last, F.lit(False)))
    numbered = grouped_row_number(at, [], ties, out="_place").withColumn(column, F.col("_place") <= among).drop("_place")
    rest = df.where((value != last) | value.isNull()).withColumn(column, F.coalesce(value < last, F.lit(False)))
    return rest.unionByName(numbered)
