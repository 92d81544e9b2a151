"""Constraints as queries that return what violates them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in one of columns."""
    if not columns:
        return df.filter(F.lit(False))
    return df.filter(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns]))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count n; keys with a null don't count as equal."""
    some = df.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns]))
    return some.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: nulls and dups (rows beyond the first of each value) of a column."""
    c = F.col(column)
    return df.agg(F.count_if(c.isNull()).alias("nulls"), (F.count("*") - F.count_distinct(c)).alias("dups"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of child whose value has no match in parent; null refers to nothing and is no orphan."""
    c, p = child.filter(F.col(f"`{column}`").isNotNull()).alias("c"), parent.select(F.col(f"`{parent_column}`").alias("key")).alias("p")
    return c.join(p, F.col(f"c.`{column}`") == F.col("p.key"), "left_anti")


def violations(df: DataFrame, not_null: list[str], unique: list[str], added: DataFrame | None = None) -> DataFrame:
    """(constraint, column_name, value, n) of everything that breaks a not-null or unique constraint. With added, only that is checked:
    its own rows, and its keys against those of df."""
    spark, target = df.sparkSession, df if added is None else added
    out = spark.createDataFrame([], "constraint string, column_name string, value string, n long")
    if not_null:
        kinds = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").isNull().alias("bad")) for c in not_null]
        bad = target.select(F.explode(F.array(*kinds)).alias("x")).filter("x.bad").groupBy("x.column_name").agg(F.count("*").alias("n"))
        out = out.unionByName(bad.select(F.lit("NOT NULL").alias("constraint"), "column_name", F.lit(None).cast("string").alias("value"), "n"))
    for c in unique:
        rows = df.select(F.col(f"`{c}`").alias("k"))
        if added is not None:
            rows = rows.join(added.select(F.col(f"`{c}`").alias("k")).distinct(), "k", "left_semi").unionByName(added.select(F.col(f"`{c}`").alias("k")))
        bad = duplicates(rows, ["k"])
        out = out.unionByName(bad.select(F.lit("UNIQUE").alias("constraint"), F.lit(c).alias("column_name"), F.col("k").cast("string").alias("value"), "n"))
    return out
