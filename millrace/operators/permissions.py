"""Bit-mask permissions: a dictionary for the session, and the same rules as queries over a table (usr, tab, mask)."""

from __future__ import annotations

import hashlib
import hmac
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.parser import PERMISSIONS
from . import relational

GLOBAL = ""


def effective(acl: DataFrame, table: str) -> DataFrame:
    """(usr, mask): the table's entry if there is one, else the global one, else 0."""
    own, everywhere = F.max(F.when(F.col("tab") == table, F.col("mask"))), F.max(F.when(F.col("tab") == GLOBAL, F.col("mask")))
    return acl.groupBy("usr").agg(F.coalesce(own, everywhere, F.lit(0)).alias("mask"))


def allowed(acl: DataFrame, table: str, mask: int) -> DataFrame:
    """(usr, ok): whether all bits of mask are granted."""
    return effective(acl, table).select("usr", (F.col("mask").bitwiseAND(mask) == mask).alias("ok"))


def merged(grants: DataFrame) -> DataFrame:
    """(usr, mask): all grants of a user together."""
    return grants.groupBy("usr").agg(F.bit_or("mask").alias("mask"))


def visible(df: DataFrame, rows=None, columns: list[str] | None = None) -> DataFrame:
    """What a row and column permission leaves of a table: rows for which the condition is true, other columns than these as null."""
    if rows is not None:
        df = relational.where(df, rows)
    if columns is None:
        return df
    shown = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{f.name}`") if f.name.lower() in shown else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])


class Users:
    """Users, their passwords (scrypt with a salt of their own) and their permissions."""

    def __init__(self) -> None:
        self.secrets: dict[str, tuple[bytes, bytes]] = {}
        self.acl: dict[str, dict[str, int]] = {}
        self.current: str | None = None
        self.owner: str | None = None
        self.views: dict[str, dict[str, tuple[str | None, list[str] | None]]] = {}  # user: table: rows and columns that may be seen

    @staticmethod
    def _hash(password: str, salt: bytes) -> bytes:
        return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1)

    def add(self, name: str, password: str) -> None:
        if name in self.secrets:
            raise EngineError(f"user {name} exists")
        salt = os.urandom(16)
        self.secrets[name] = salt, self._hash(password, salt)

    def remove(self, name: str) -> None:
        self.secrets.pop(name, None)
        self.acl.pop(name, None)
        self.views.pop(name, None)
        if self.owner == name:
            self.owner = None
        if self.current == name:
            self.current = None

    def set_owner(self, name: str) -> None:
        """The user whom nothing is denied, and who alone changes tables' definitions and others' permissions. There is none by default."""
        if name not in self.secrets:
            raise EngineError(f"no user {name}")
        self.owner = name

    def set_current(self, name: str | None) -> None:
        """Acts as a user without a password (the embedding program's choice); None: as the program itself."""
        if name is not None and name not in self.secrets:
            raise EngineError(f"no user {name}")
        self.current = name

    def owns(self) -> bool:
        """Whether definitions and permissions may be changed: by the owner, or by the program itself when nobody is logged in."""
        return self.current is None or self.current == self.owner

    def restrict(self, user: str, table: str, rows: str | None = None, columns: list[str] | None = None) -> None:
        """What the user sees of a table: rows that meet a condition of the engine's grammar, these columns only. None: all."""
        self.views.setdefault(user, {})[table.lower()] = (rows, columns)

    def view(self, table: str) -> tuple[str | None, list[str] | None]:
        """Restriction of the current user on a table."""
        if self.current is None or self.current == self.owner:
            return None, None
        return self.views.get(self.current, {}).get(table.lower(), (None, None))

    def login(self, name: str, password: str) -> bool:
        salt, want = self.secrets.get(name, (b"", b""))
        if want and hmac.compare_digest(self._hash(password, salt), want):
            self.current = name
            return True
        return False

    def logout(self) -> None:
        self.current = None

    @property
    def authenticated(self) -> bool:
        return self.current is not None

    def grant(self, user: str, mask: int, table: str = GLOBAL) -> None:
        own = self.acl.setdefault(user, {})
        own[table] = own.get(table, 0) | mask

    def revoke(self, user: str, mask: int, table: str = GLOBAL) -> None:
        """Takes bits away; leaves an entry, which for a table hides the global one."""
        own = self.acl.setdefault(user, {})
        own[table] = own.get(table, 0) & ~mask

    def mask(self, user: str, table: str = GLOBAL) -> int:
        own = self.acl.get(user, {})
        return own.get(table, own.get(GLOBAL, 0))

    def has(self, user: str, mask: int, table: str = GLOBAL) -> bool:
        return user == self.owner or self.mask(user, table) & mask == mask

    def may(self, permission: str, table: str) -> bool:
        """Whether the current user has the permission; without a user everything is allowed."""
        return self.current is None or self.has(self.current, PERMISSIONS[permission], table)
