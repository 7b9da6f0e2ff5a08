"""Expectations: violations as rows, and an action that raises when there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, name: str, holds: Column, *keep: str) -> DataFrame:
    """(expectation, kept columns) for rows where the predicate isn't true."""
    return df.filter(~F.coalesce(holds, F.lit(False))).select(F.lit(name).alias("expectation"), *keep)


def expect(df: DataFrame, name: str, holds: Column) -> DataFrame:
    """`df` itself, or ValueError naming the expectation (never a row's values)."""
    if not violations(df, name, holds).isEmpty():
        raise ValueError(f"expectation failed: {name}")
    return df


def expect_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if df.columns != columns:
        raise ValueError(f"columns are {df.columns}, not {columns}")
    return df


def id_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct ids, null ids, repeated ids (rows beyond the first)."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    real = F.col(key).isNotNull()
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(real).alias("ids"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(real, F.col("n") - 1)), F.lit(0)).alias("repeated"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) as (column, nulls)")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: number of keys on both sides."""
    return a.select(key).intersect(b.select(key)).filter(F.col(key).isNotNull()).agg(F.count("*").alias("shared"))
