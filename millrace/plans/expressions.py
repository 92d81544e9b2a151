"""Expression nodes to Spark columns. Types come from the input schema; nothing goes through Spark's own parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from . import nodes as n

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*WHOLE, T.FloatType, T.DoubleType, T.DecimalType)


def field_of(schema: T.StructType, name: str) -> T.StructField:
    for f in schema.fields:
        if f.name.lower() == name.lower():
            return f
    raise EngineError(f"no column {name}; there are {', '.join(schema.names)}")


def _whole(t) -> bool:
    return isinstance(t, WHOLE)


def build(e, schema: T.StructType) -> tuple[Column, T.DataType]:
    """Column and its type. A string column compared with a number compares as text, as the number is written."""
    if isinstance(e, n.Literal):
        kind = {bool: T.BooleanType(), int: T.IntegerType() if isinstance(e.value, int) and abs(e.value) < 1 << 31 else T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}[type(e.value)]
        return F.lit(e.value), kind
    if isinstance(e, n.Name):
        f = field_of(schema, e.name)
        return F.col(f"`{f.name}`"), f.dataType
    if isinstance(e, n.Not):
        return ~build(e.value, schema)[0], T.BooleanType()
    if isinstance(e, n.IsNull):
        c = build(e.value, schema)[0]
        return (c.isNotNull() if e.negated else c.isNull()), T.BooleanType()
    if isinstance(e, n.Negate):
        c, t = build(e.value, schema)
        return -c, t
    (l, lt), (r, rt) = build(e.left, schema), build(e.right, schema)
    if e.op in ("AND", "OR"):
        return (l & r if e.op == "AND" else l | r), T.BooleanType()
    if e.op in ("=", "!=", "<", "<=", ">", ">="):
        if isinstance(lt, T.StringType) and isinstance(rt, NUMERIC):
            r = F.lit(e.right.text) if isinstance(e.right, n.Literal) else r.cast("string")
        elif isinstance(rt, T.StringType) and isinstance(lt, NUMERIC):
            if isinstance(e.left, n.Literal):
                l = F.lit(e.left.text)
            elif not isinstance(e.right, n.Literal):
                l = l.cast("string")
        return {"=": l == r, "!=": l != r, "<": l < r, "<=": l <= r, ">": l > r, ">=": l >= r}[e.op], T.BooleanType()
    wide = T.LongType() if _whole(lt) and _whole(rt) else T.DoubleType()
    if e.op == "/":
        if _whole(lt) and _whole(rt):
            # div truncates towards zero; a zero divisor raises in ANSI mode, which both branches keep
            return F.call_function("div", l, r), T.LongType()
        return l / r, T.DoubleType()
    if _whole(wide):
        l, r = l.cast("long"), r.cast("long")
    return {"+": l + r, "-": l - r, "*": l * r, "%": l % r}[e.op], wide


def predicate(e, schema: T.StructType) -> Column:
    """A condition. It may be null; filters and joins take null for false, and a bare condition is what reaches the scan."""
    c, t = build(e, schema)
    return c if isinstance(t, T.BooleanType) else c.cast("boolean")


def label(e) -> str:
    """Name of an output column without an alias."""
    if isinstance(e, n.Name):
        return e.name
    if isinstance(e, n.Literal):
        return e.text
    if isinstance(e, n.Binary):
        return f"({label(e.left)} {e.op} {label(e.right)})"
    if isinstance(e, (n.Not, n.Negate)):
        return f"{'NOT ' if isinstance(e, n.Not) else '-'}{label(e.value)}"
    return f"{label(e.value)} IS {'NOT ' if e.negated else ''}NULL"
