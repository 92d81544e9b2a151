"""The engine: runs statements against a catalog of versioned tables."""

from __future__ import annotations

import json
import logging
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from . import catalog as cat
from .errors import ConstraintViolation, EngineError, ParseError, PermissionDenied
from .operators import changes, integrity, permissions
from .operators import relational as rel
from .plans import expressions as ex
from .plans import nodes as n
from .plans.parser import PERMISSIONS, parse_expression, parse_script
from .plans.types import spark_type
from .sources import storage

log = logging.getLogger("millrace.audit")
#: Statements that the audit log of a session holds; all go to Python's logging.
AUDITED = 10_000
#: After so many changes a table is written out and read again, so that its plan stays short.
MOST_CHANGES = 10


class Engine:
    """With a path, commit() writes there and opening reads what is there; without one, tables live in the session only. With a key (16, 24
    or 32 characters), what is committed is encrypted.

    When a user is logged in, reading and changing rows takes the permissions of its name, and a change that reads rows (a condition, an
    expression over columns) takes SELECT too; definitions of tables, layouts, users, permissions, commit() and load() are the owner's.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, validate: bool = True, key: str | None = None):
        self.spark, self.path, self.validate, self.key = spark, path, validate, key
        self.reset()
        if path is not None:
            self.load(path)

    def reset(self) -> None:
        """Forgets tables, users, variables and the audit log; what is committed stays."""
        self.catalog, self.users = cat.Catalog(), permissions.Users()
        self.variables: dict[str, object] = {}
        self.audit: deque[tuple] = deque(maxlen=AUDITED)

    # tables

    def register(self, name: str, data: DataFrame) -> None:
        """An existing DataFrame as a table."""
        self._own(f"register {name}")
        self.catalog.add(name, cat.Table(data))

    def register_folder(self, folder: str, *names: str) -> None:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        self._need("SELECT", name)
        return permissions.visible(self.catalog.get(name).data, *self.users.view(name))

    def tables(self) -> list[str]:
        return self.catalog.names()

    def create_table(self, name: str, columns: list[n.ColumnDef]) -> None:
        self._own(f"create {name}")
        schema = T.StructType([T.StructField(c.name, spark_type(c.type)) for c in columns])
        self.catalog.add(name, cat.Table(self.spark.createDataFrame([], schema), {c.name: c for c in columns}))

    def drop_table(self, name: str) -> None:
        self._own(f"drop {name}")
        self.catalog.drop(name)

    def add_foreign_key(self, table: str, column: str, parent: str, parent_column: str) -> None:
        self._need("REFERENCES", table)
        self.catalog.get(table).foreign_keys.append((column, parent, parent_column))

    def check_foreign_keys(self, table: str) -> dict[str, DataFrame]:
        """Orphans of each foreign key, by column."""
        t = self.catalog.get(table)
        for name in (table, *(p for _, p, _ in t.foreign_keys)):
            self._need("SELECT", name)
        return {c: integrity.orphans(t.data, c, self.catalog.get(p).data, pc) for c, p, pc in t.foreign_keys}

    def add_index(self, table: str, column: str) -> None:
        """A layout: the table is committed in order of the first such column, with Bloom filters of the others. Results never depend on it."""
        self._own(f"index {table}")
        t = self.catalog.get(table)
        name = ex.field_of(t.data.schema, column).name
        if name not in t.indexes:
            t.indexes.append(name)
            t.dirty = True

    def remove_index(self, table: str, column: str) -> None:
        self._own(f"index {table}")
        t = self.catalog.get(table)
        t.indexes = [c for c in t.indexes if c.lower() != column.lower()]

    # queries and changes

    def select(self, table: str, where: rel.Condition | None = None) -> DataFrame:
        df = self.table(table)
        return df if where is None else rel.where(df, where)

    def join_tables(self, left: str, right: str, cond: str | Callable) -> DataFrame:
        return rel.join(self.table(left), self.table(right), cond)

    def insert(self, table: str, rows: list[tuple | dict], columns: tuple[str, ...] = (), *, validate: bool | None = None) -> None:
        self._need("INSERT", table)
        t = self.catalog.get(table)
        if rows and isinstance(rows[0], dict):
            columns = columns or tuple(rows[0])
            rows = [tuple(r.get(c) for c in columns) for r in rows]
        named = {c.lower() for c in columns} if columns else {f.lower() for f in t.data.columns}
        counted = [c for c in t.columns.values() if c.auto_increment and c.name.lower() not in named]
        defaults = {c.name: c.default for c in t.columns.values() if c.default is not None}
        new = changes.new_rows(t.data, rows, columns, defaults)
        if counted:
            first = t.data.selectExpr(*[f"coalesce(max(`{c.name}`), 0) AS `{c.name}`" for c in counted]).first()
            new = self.spark.createDataFrame([tuple(first[f.name] + i if any(c.name == f.name for c in counted) else r[f.name] for f in new.schema) for i, r in enumerate(new.collect(), 1)], new.schema)  # rows of one statement
        if self.validate if validate is None else validate:
            self._check(table, t.data, t.not_null(), t.unique(), new)
        self._change(t, t.data.unionByName(new))

    def validate_rows(self, table: str, rows: list[tuple], columns: tuple[str, ...] = ()) -> DataFrame:
        """What adding the rows would violate; empty if nothing."""
        self._need("INSERT", table)
        self._need("SELECT", table)
        t = self.catalog.get(table)
        return integrity.violations(t.data, t.not_null(), t.unique(), changes.new_rows(t.data, rows, columns))

    def update(self, table: str, assignments: dict, where: rel.Condition | None = None, *, validate: bool | None = None) -> None:
        self._need("UPDATE", table)
        if where is not None or any(n.names_in(v) if hasattr(v, "__dataclass_fields__") else isinstance(v, Column) for v in assignments.values()):
            self._need("SELECT", table)
        self._whole(table)
        t = self.catalog.get(table)
        if self.validate if validate is None else validate:
            touched = {c.lower() for c in assignments}
            not_null, unique = ([c for c in x if c.lower() in touched] for x in (t.not_null(), t.unique()))
            if not_null or unique:
                hit = rel.where(t.data, where) if where is not None else t.data
                rest = changes.delete(t.data, where)
                self._check(table, rest, not_null, unique, changes.update(hit, assignments).select(*t.data.columns))
        self._change(t, changes.update(t.data, assignments, where))

    def delete(self, table: str, where: rel.Condition | None = None) -> None:
        self._need("DELETE", table)
        if where is not None:
            self._need("SELECT", table)
        self._whole(table)
        t = self.catalog.get(table)
        self._change(t, changes.delete(t.data, where))

    def _need(self, permission: str, table: str) -> None:
        self.catalog.get(table)
        if not self.users.may(permission, table):
            raise PermissionDenied(f"{self.users.current} may not {permission} on {table}")

    def _own(self, what: str) -> None:
        if not self.users.owns():
            raise PermissionDenied(f"{self.users.current} may not {what}")

    def _whole(self, table: str) -> None:
        if self.users.view(table) != (None, None):
            raise PermissionDenied(f"{self.users.current} sees {table} in part and may not change it")

    def _check(self, table: str, data: DataFrame, not_null: list[str], unique: list[str], new: DataFrame) -> None:
        """Raises if new rows beside data break a constraint; without constraints, nothing runs."""
        first = integrity.violations(data, not_null, unique, new).limit(3).collect() if not_null or unique else []
        if first:
            raise ConstraintViolation(f"{table}: " + "; ".join(f"{r.constraint} {r.column_name}" + (f" = {r.value}" if r.value is not None else "") for r in first))

    def _change(self, t: cat.Table, data: DataFrame) -> None:
        t.changes += 1
        t.dirty = True
        if t.changes >= MOST_CHANGES and self.spark.conf.get("spark.checkpoint.dir", None):
            data, t.changes = data.checkpoint(), 0
        t.data = data

    # users

    def add_user(self, name: str, password: str) -> None:
        self._own("add users")
        self.users.add(name, password)

    def remove_user(self, name: str) -> None:
        self._own("remove users")
        self.users.remove(name)

    def set_owner(self, name: str) -> None:
        self._own("name the owner")
        self.users.set_owner(name)

    def restrict(self, user: str, table: str, rows: str | None = None, columns: list[str] | None = None) -> None:
        self._own("restrict users")
        self.catalog.get(table)
        self.users.restrict(user, table, rows, columns)

    # statements

    def run(self, s) -> DataFrame | None:
        """One parsed statement; SELECT gives a DataFrame. What was run, by whom, on what and how it went is kept in the audit log."""
        entry = (datetime.now(UTC), self.users.current, type(s).__name__, getattr(s, "table", None))
        try:
            out = self._run(n.bound(s, self.variables))
        except Exception as e:
            self._note(*entry, type(e).__name__)
            raise
        self._note(*entry, "ok")
        return out

    def _note(self, at: datetime, user: str | None, statement: str, table: str | None, outcome: str) -> None:
        self.audit.append((at, user, statement, table, outcome))
        log.log(logging.INFO if outcome == "ok" else logging.WARNING, "%s by %s on %s: %s", statement, user or "-", table or "-", outcome)

    def audited(self) -> DataFrame:
        """The last AUDITED statements: (at, usr, statement, tab, outcome)."""
        return self.spark.createDataFrame(list(self.audit), "at timestamp, usr string, statement string, tab string, outcome string")

    def _run(self, s) -> DataFrame | None:
        if isinstance(s, n.Select):
            return self._select(s)
        if isinstance(s, n.Create):
            self.create_table(s.table, list(s.columns))
        elif isinstance(s, n.Drop):
            self.drop_table(s.table)
        elif isinstance(s, n.Insert):
            self.insert(s.table, list(s.rows), s.columns)
        elif isinstance(s, n.Update):
            self.update(s.table, dict(s.assignments), self._where(s))
        elif isinstance(s, n.Delete):
            self.delete(s.table, self._where(s))
        elif isinstance(s, n.Assign):
            self.variables[s.name] = self.spark.range(1).select(ex.build(s.value, T.StructType())[0].alias("v")).first().v
        elif isinstance(s, n.Grant):
            self._own("grant or revoke")
            (self.users.revoke if s.revoke else self.users.grant)(s.user, PERMISSIONS[s.permission], s.table)
        else:
            raise EngineError(f"not a statement: {s!r}")
        return None

    def _where(self, s) -> Column | None:
        return None if s.where is None else ex.predicate(s.where, self.catalog.get(s.table).data.schema)

    def _select(self, s: n.Select) -> DataFrame:
        df = self.table(s.table)
        if s.join:
            other, cond = s.join
            df = rel.join(df, self.table(other), cond)
        if s.where is not None:
            df = df.filter(ex.predicate(s.where, df.schema))
        if s.group:
            bare = [e.name for e, _ in s.items if isinstance(e, n.Name)]
            if len(bare) < len(s.items) or {c.lower() for c in bare} - {c.lower() for c in s.group}:
                raise EngineError("only grouped columns can be selected")
            df = rel.group_keys(df, *s.group)
        chosen = [ex.build(e, df.schema)[0].alias(a or ex.label(e)) for e, a in s.items]
        names = {(a or ex.label(e)).lower() for e, a in s.items}
        early = bool(s.order) and not all(c.lower() in names for c, _ in s.order) if chosen else False
        if chosen and not early:
            df = df.select(*chosen)
        if s.order:
            df = rel.order_by(df, *s.order)
        df = rel.window(df, s.limit, s.offset)
        return df.select(*chosen) if early else df

    def query(self, text: str) -> DataFrame | None:
        """Runs statements; gives the result of the last."""
        out = None
        for s in parse_script(text):
            out = self.run(s)
        return out

    def steps(self, text: str) -> Iterator[tuple[object, DataFrame | None]]:
        """Runs one statement each time the next result is asked for."""
        for s in parse_script(text):
            yield s, self.run(s)

    def script(self, text: str) -> list[tuple[object, DataFrame | Exception | None]]:
        """Runs every statement that parses, in order, each once; a failing one is reported and the script goes on."""
        errors: list[ParseError] = []
        out: list = []
        for s in parse_script(text, errors):
            try:
                out.append((s, self.run(s)))
            except EngineError as e:
                out.append((s, e))
        return out + [(None, e) for e in errors]

    @staticmethod
    def check(text: str) -> list[ParseError]:
        """Errors of a script; nothing runs."""
        errors: list[ParseError] = []
        parse_script(text, errors)
        return errors

    def compile(self, text: str) -> DataFrame:
        """The statements of a script as rows (step, kind, plan)."""
        rows = [(i, type(s).__name__, repr(s)) for i, s in enumerate(parse_script(text))]
        return self.spark.createDataFrame(rows, "step int, kind string, plan string")

    def explain(self, text: str) -> str:
        df = self.query(text)
        return "" if df is None else df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # persistence

    def commit(self, path: str | None = None) -> None:
        """Writes changed tables and a new manifest with schemas, keys, users and permissions."""
        self._own("commit")
        root = path or self.path
        if root is None:
            raise EngineError("a database without a path cannot be committed")
        tables = {}
        for name, t in self.catalog.tables.items():
            if t.dirty or t.folder is None or root != self.path:
                t.folder = storage.write_table(t.data, root, name, order=t.indexes, key=self.key)
                t.data = storage.read_table(self.spark, f"{root}/{t.folder}", t.data.schema, self.key)
                t.dirty, t.changes = False, 0
            tables[name] = {
                "folder": t.folder, "schema": t.data.schema.jsonValue(), "foreign_keys": t.foreign_keys, "indexes": t.indexes,
                "columns": [{"name": c.name, "type": c.type, "primary_key": c.primary_key, "unique": c.unique, "not_null": c.not_null, "auto_increment": c.auto_increment, "default": c.default.text if isinstance(c.default, n.Literal) else None, "quoted": isinstance(c.default, n.Literal) and isinstance(c.default.value, str)} for c in t.columns.values()],
            }
        secrets = {u: [s.hex(), h.hex()] for u, (s, h) in self.users.secrets.items()}
        storage.save_manifest(self.spark, root, {"version": uuid.uuid4().hex, "tables": tables, "users": secrets, "acl": self.users.acl, "owner": self.users.owner, "views": self.users.views, "sealed": self.key is not None})
        self.path = root

    def load(self, path: str) -> bool:
        """Replaces all tables by those of a committed database; false if there is none."""
        self._own("load")
        data = storage.load_manifest(self.spark, path)
        if data is None:
            return False
        if data["sealed"] != (self.key is not None):
            raise EngineError("the database is encrypted, and there is no key" if data["sealed"] else "the database is not encrypted")
        self.catalog = cat.Catalog()
        for name, t in data["tables"].items():
            columns = {}
            for c in t["columns"]:
                quoted, text = c.pop("quoted"), c.pop("default")
                default = None if text is None else n.Literal(text, text) if quoted else parse_expression(text)
                columns[c["name"]] = n.ColumnDef(**c, default=default)
            frame = storage.read_table(self.spark, f"{path}/{t['folder']}", T.StructType.fromJson(t["schema"]), self.key)
            self.catalog.add(name, cat.Table(frame, columns, [tuple(k) for k in t["foreign_keys"]], t["indexes"], 0, False, t["folder"]))
        self.users.secrets = {u: (bytes.fromhex(s), bytes.fromhex(h)) for u, (s, h) in data["users"].items()}
        self.users.acl, self.users.owner = {u: dict(x) for u, x in data["acl"].items()}, data["owner"]
        self.users.views = {u: {t: tuple(v) for t, v in x.items()} for u, x in data["views"].items()}
        return True

    def export_csv(self, table: str, path: str) -> None:
        storage.export_csv(self.table(table), path)

    def export_json(self, table: str, path: str) -> None:
        storage.export_json(self.table(table), path)

    def describe(self) -> str:
        return json.dumps({t: self.catalog.get(t).data.schema.simpleString() for t in self.tables()})
