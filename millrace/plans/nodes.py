"""Statement and expression nodes."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

from ..errors import EngineError


@dataclass(frozen=True)
class Literal:
    value: object
    text: str  # as written


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    value: object


@dataclass(frozen=True)
class Negate:
    value: object


@dataclass(frozen=True)
class IsNull:
    value: object
    negated: bool


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False
    unique: bool = False
    not_null: bool = False
    auto_increment: bool = False
    default: object = None


@dataclass(frozen=True)
class Create:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class Drop:
    table: str


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple = ()  # (expression, alias or None); empty: *
    where: object = None
    group: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # (name, descending)
    limit: int | None = None
    offset: int | None = None
    join: tuple[str, object] | None = None  # (table, condition)


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, object], ...]
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Grant:
    permission: str
    table: str
    user: str
    revoke: bool = field(default=False)


def bound(node, variables: dict[str, object]):
    """node with the variables that it names replaced by their values."""
    if isinstance(node, Variable):
        if node.name not in variables:
            raise EngineError(f"no variable @{node.name}")
        value = variables[node.name]
        return Literal(value, "" if value is None else str(value))
    if isinstance(node, tuple):
        return tuple(bound(x, variables) for x in node)
    if is_dataclass(node):
        return replace(node, **{f.name: bound(getattr(node, f.name), variables) for f in fields(node)})
    return node


def names_in(node) -> set[str]:
    """Columns that an expression reads."""
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, tuple):
        return set().union(*(names_in(x) for x in node), set())
    return set().union(*(names_in(getattr(node, f.name)) for f in fields(node)), set()) if is_dataclass(node) else set()
