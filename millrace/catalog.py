"""Table names and what they stand for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .errors import MissingTable, TableExists
from .plans.nodes import ColumnDef


@dataclass
class Table:
    data: DataFrame
    columns: dict[str, ColumnDef] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    changes: int = 0  # versions stacked since the lineage was last cut
    dirty: bool = True
    folder: str | None = None

    def not_null(self) -> list[str]:
        return [c.name for c in self.columns.values() if c.not_null or c.primary_key]

    def unique(self) -> list[str]:
        return [c.name for c in self.columns.values() if c.unique or c.primary_key]


class Catalog:
    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}

    def get(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise MissingTable(f"no table {name}")
        return self.tables[name.lower()]

    def add(self, name: str, table: Table) -> None:
        if name.lower() in self.tables:
            raise TableExists(f"table {name} exists")
        self.tables[name.lower()] = table

    def drop(self, name: str) -> None:
        """Silent if there is no such table."""
        self.tables.pop(name.lower(), None)

    def names(self) -> list[str]:
        return sorted(self.tables)
