"""INSERT, UPDATE and DELETE as new versions of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..plans import expressions as ex
from ..plans import nodes as n
from ..plans.parser import parse_expression
from .relational import Condition, condition


def insert(df: DataFrame, rows: list[tuple], columns: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """df and rows of values or expression nodes. Columns that are not named get their default, else null."""
    return df.unionByName(new_rows(df, rows, columns, defaults))


def new_rows(df: DataFrame, rows: list[tuple], columns: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    names = [ex.field_of(schema, c).name for c in columns] if columns else schema.names
    if len(set(names)) < len(names):
        raise EngineError("a column is named twice")
    for r in rows:
        if len(r) != len(names):
            raise EngineError(f"{len(r)} values for {len(names)} columns")
    one, frames = spark.range(1), []
    plain = all(isinstance(v, n.Literal) or not hasattr(v, "__dataclass_fields__") for r in rows for v in r)
    defaults = {k.lower(): v for k, v in (defaults or {}).items()}

    def rest(f: T.StructField):
        v = defaults.get(f.name.lower())
        return (ex.build(v, T.StructType())[0] if hasattr(v, "__dataclass_fields__") else F.lit(v)).cast(f.dataType).alias(f.name)

    if plain:  # one local relation for any number of rows
        raw = [tuple(None if v is None else str(v) if not isinstance(v, bool) else str(v).lower() for v in ((x.value if not isinstance(x, n.Literal) or x.value is None or isinstance(x.value, bool) else x.text) if isinstance(x, n.Literal) else x for x in r)) for r in rows]
        local = spark.createDataFrame(raw, T.StructType([T.StructField(c, T.StringType()) for c in names]))
        return local.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in names else rest(f) for f in schema.fields])
    for r in rows:
        values = dict(zip(names, r))
        cells = []
        for f in schema.fields:
            v = values.get(f.name)
            cells.append((ex.build(v, T.StructType())[0] if hasattr(v, "__dataclass_fields__") else F.lit(v)).cast(f.dataType).alias(f.name) if f.name in values else rest(f))
        frames.append(one.select(*cells))
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def update(df: DataFrame, assignments: dict[str, object], where: Condition | None = None) -> DataFrame:
    """All assignments see the old row. A new column is added, null where nothing matched; values take the column's type."""
    cond = F.lit(True) if where is None else F.coalesce(condition(df, where), F.lit(False))
    known = {f.name.lower(): f for f in df.schema.fields}
    out = {}
    for name, value in assignments.items():
        if hasattr(value, "__dataclass_fields__"):
            v = ex.build(value, df.schema)[0]
        else:
            v = value if not isinstance(value, (str, int, float, bool, type(None))) else F.lit(value)
        f = known.get(name.lower())
        out[f.name if f else name] = F.when(cond, v.cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) if f else F.when(cond, v)
    return df.withColumns(out)


def delete(df: DataFrame, where: Condition | None = None) -> DataFrame:
    """Rows for which where is not true stay."""
    if where is None:
        return df.filter(F.lit(False))
    return df.filter(~F.coalesce(condition(df, where), F.lit(False)))


def expression(text: str):
    """An expression of the engine's grammar as a value for update()."""
    return parse_expression(text)
