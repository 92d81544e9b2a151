"""Filter, project, sort, group, limit, join and look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import expressions as ex
from ..plans.parser import parse_expression

Condition = Column | str | Callable


def condition(df: DataFrame, where: Condition) -> Column:
    """A filter from a column, a text in the engine's grammar, or (slow, row by row) a Python predicate over a row."""
    if isinstance(where, Column):
        return where
    if isinstance(where, str):
        return ex.predicate(parse_expression(where), df.schema)
    return F.udf(where, "boolean")(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def where(df: DataFrame, cond: Condition) -> DataFrame:
    """Rows for which cond is true; unknown counts as false."""
    return df.filter(condition(df, cond))


def project(df: DataFrame, *items: str) -> DataFrame:
    """Columns and expressions, each with an optional " AS name"."""
    out = []
    for item in items:
        text, _, name = item.partition(" AS ")
        e = parse_expression(text)
        out.append(ex.build(e, df.schema)[0].alias(name.strip() or ex.label(e)))
    return df.select(*out)


def order_by(df: DataFrame, *columns: str | tuple[str, bool]) -> DataFrame:
    """Ascending with nulls first; (name, True) is descending with nulls last."""
    keys = [(c, False) if isinstance(c, str) else c for c in columns]
    return df.orderBy(*[F.col(ex.field_of(df.schema, c).name).desc_nulls_last() if down else F.col(ex.field_of(df.schema, c).name).asc_nulls_first() for c, down in keys])


def group_keys(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct keys: grouping without an aggregate."""
    return df.select(*[ex.field_of(df.schema, c).name for c in columns]).distinct()


def window(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def join(left: DataFrame, right: DataFrame, cond: str | Callable[[DataFrame, DataFrame], Column] | object) -> DataFrame:
    """Inner join on any condition; of columns with one name the right one stays. Row order is not kept.

    cond is a text (or its expression) in which names are looked up in the right table first, or a function of the two DataFrames.
    Equalities become hash or sort-merge joins, of which Spark picks by size; others compare all rows.
    """
    here = {c.lower() for c in right.columns}
    kept = [c for c in left.columns if c.lower() not in here]
    if not callable(cond):
        l = left.select(*[F.col(f"`{c}`") for c in kept])  # a name of both sides means the right one, so the left one is not needed
        node = parse_expression(cond) if isinstance(cond, str) else cond
        joined = l.join(right, ex.predicate(node, T.StructType(l.schema.fields + right.schema.fields)), "inner")
        return joined.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`") for c in right.columns])
    la, ra = left.alias("l"), right.alias("r")
    joined = la.join(ra, cond(_Side("l", left), _Side("r", right)), "inner")
    return joined.select(*[F.col(f"l.`{c}`") for c in kept], *[F.col(f"r.`{c}`") for c in right.columns])


def join_rows(left: DataFrame, right: DataFrame, predicate: Callable) -> DataFrame:
    """join() with a Python predicate over two rows: the slow way, which compares all rows one by one in Python. A condition that can be
    a column belongs into join()."""
    both = F.udf(predicate, "boolean")
    side = lambda s, df: F.struct(*[s[c].alias(c) for c in df.columns])
    return join(left, right, lambda l, r: both(side(l, left), side(r, right)))


def upsert(df: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """df with rows put in by key: those of a known key take its place. Keys occur once in rows. Null keys are never known."""
    return df.join(rows.select(key), key, "left_anti").select(*df.columns).unionByName(rows)


def remove(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df without the rows whose key is among keys (one column of the same name)."""
    return df.join(keys, key, "left_anti").select(*df.columns)


class _Side:
    """Columns of one side of a join: side["name"] or side.name."""

    def __init__(self, alias: str, df: DataFrame):
        self._alias, self._df = alias, df

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self._alias}.`{ex.field_of(self._df.schema, name).name}`")

    def __getattr__(self, name: str) -> Column:
        return self[name]


def point(df: DataFrame, column: str, value) -> DataFrame:
    """Every row whose column has the value."""
    return df.filter(F.col(column) == F.lit(value))


def among(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows in [low, high], both ends included, in key order."""
    return df.filter(F.col(column).between(F.lit(low), F.lit(high))).orderBy(F.col(column).asc_nulls_first())


def bounds(df: DataFrame, column: str, value) -> DataFrame:
    """One row: lb, the least value not below, and ub, the least value above."""
    c, v = F.col(column), F.lit(value)
    return df.agg(F.min(F.when(c >= v, c)).alias("lb"), F.min(F.when(c > v, c)).alias("ub"))


def keys(df: DataFrame, column: str) -> DataFrame:
    """All values of a column in ascending order, repeats included."""
    return df.select(column).filter(F.col(column).isNotNull()).orderBy(column)


def prefix(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.startswith(F.col(column), F.lit(text)))
