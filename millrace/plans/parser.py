"""Script to statements: recursive descent, precedence climbing for expressions."""

from __future__ import annotations

from ..errors import ParseError
from . import nodes as n
from .lexer import Token, tokenize

#: Loosest first; all left-associative. NOT binds between AND and comparison.
PRECEDENCE = {"OR": 1, "AND": 2, "=": 4, "==": 4, "!=": 4, "<>": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
NOT_LEVEL = 3
PERMISSIONS = {"SELECT": 1, "INSERT": 2, "UPDATE": 4, "DELETE": 8, "TRUNCATE": 16, "REFERENCES": 32, "TRIGGER": 64, "ALL": 127}


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        t = self.now
        self.at += t.kind != "end"
        return t

    def accept(self, *texts: str) -> Token | None:
        return self.take() if self.now.is_(*texts) else None

    def expect(self, text: str) -> Token:
        if not self.now.is_(text):
            raise ParseError(f"expected {text}, found {self.now.text or 'the end'!r}", self.now.position)
        return self.take()

    def name(self) -> str:
        if self.now.kind != "word":
            raise ParseError(f"expected a name, found {self.now.text or 'the end'!r}", self.now.position)
        return self.take().text

    def names(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        return tuple(out)

    def whole(self, what: str) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise ParseError(f"expected {what}", self.now.position)
        return int(self.take().text)

    # expressions

    def expression(self, least: int = 1):
        if self.accept("NOT"):
            left = n.Not(self.expression(NOT_LEVEL))
        elif self.accept("-"):
            left = n.Negate(self.expression(8))
        else:
            left = self.primary()
        while True:
            if self.now.is_("IS") and least <= 4:
                self.take()
                negated = bool(self.accept("NOT"))
                self.expect("NULL")
                left = n.IsNull(left, negated)
                continue
            level = PRECEDENCE.get(self.now.text) if self.now.kind in ("op", "keyword") else None
            if level is None or level < least:
                return left
            op = self.take().text
            left = n.Binary({"==": "=", "<>": "!="}.get(op, op), left, self.expression(level + 1))

    def primary(self):
        t = self.take()
        if t.is_("("):
            inner = self.expression()
            self.expect(")")
            return inner
        if t.kind == "number":
            return n.Literal(float(t.text) if "." in t.text else int(t.text), t.text)
        if t.kind == "string":
            return n.Literal(t.text, t.text)
        if t.kind == "word":
            return n.Name(t.text)
        if t.kind == "variable":
            return n.Variable(t.text[1:])
        if t.is_("NULL", "TRUE", "FALSE"):
            return n.Literal({"NULL": None, "TRUE": True, "FALSE": False}[t.text], t.text)
        raise ParseError(f"expected an expression, found {t.text or 'the end'!r}", t.position)

    # statements

    def statement(self):
        t = self.take()
        kind = {"CREATE": self.create, "DROP": self.drop, "SELECT": self.select, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "GRANT": self.grant, "REVOKE": self.revoke, "SET": self.assign}.get(t.text if t.kind == "keyword" else "")
        if kind is None:
            raise ParseError(f"unknown statement {t.text or 'the end'!r}", t.position)
        out = kind()
        if self.now.kind != "end" and not self.now.is_(";"):
            raise ParseError(f"unexpected {self.now.text!r}", self.now.position)
        return out

    def create(self):
        self.expect("TABLE")
        table = self.name()
        self.expect("(")
        columns = [self.column()]
        while self.accept(","):
            columns.append(self.column())
        self.expect(")")
        if len({c.name.lower() for c in columns}) < len(columns):
            raise ParseError(f"a column of {table} is defined twice", self.now.position)
        return n.Create(table, tuple(columns))

    def column(self) -> n.ColumnDef:
        name, type_ = self.name(), self.name()
        if self.accept("("):
            sizes = [str(self.whole("a size"))]
            while self.accept(","):
                sizes.append(str(self.whole("a size")))
            self.expect(")")
            type_ += f"({','.join(sizes)})"
        flags: dict = {}
        while True:
            if self.accept("PRIMARY"):
                self.accept("KEY")
                flags["primary_key"] = True
            elif self.accept("NOT"):
                self.expect("NULL")
                flags["not_null"] = True
            elif self.accept("UNIQUE"):
                flags["unique"] = True
            elif self.accept("AUTO_INCREMENT"):
                flags["auto_increment"] = True
            elif self.accept("DEFAULT"):
                flags["default"] = self.expression(8)
            elif not self.accept("NULL", "KEY"):
                return n.ColumnDef(name, type_, **flags)

    def drop(self):
        self.expect("TABLE")
        return n.Drop(self.name())

    def select(self):
        items = []
        if not self.accept("*"):
            while True:
                e = self.expression()
                items.append((e, self.name() if self.accept("AS") else None))
                if not self.accept(","):
                    break
        self.expect("FROM")
        table, join, where, group, order, limit, offset = self.name(), None, None, (), [], None, None
        if self.accept("JOIN"):
            other = self.name()
            self.expect("ON")
            join = (other, self.expression())
        if self.accept("WHERE"):
            where = self.expression()
        if self.accept("GROUP"):
            self.expect("BY")
            group = self.names()
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                c = self.name()
                order.append((c, bool(self.accept("DESC")) if not self.accept("ASC") else False))
                if not self.accept(","):
                    break
        if self.accept("LIMIT"):
            limit = self.whole("a number of rows")
        if self.accept("OFFSET"):
            offset = self.whole("a number of rows")
        return n.Select(table, tuple(items), where, group, tuple(order), limit, offset, join)

    def insert(self):
        self.expect("INTO")
        table, columns = self.name(), ()
        if self.accept("("):
            columns = self.names()
            self.expect(")")
        self.expect("VALUES")
        rows = []
        while True:
            self.expect("(")
            row = [self.expression()]
            while self.accept(","):
                row.append(self.expression())
            self.expect(")")
            rows.append(tuple(row))
            if not self.accept(","):
                return n.Insert(table, columns, tuple(rows))

    def update(self):
        table = self.name()
        self.expect("SET")
        out = []
        while True:
            c = self.name()
            self.expect("=")
            out.append((c, self.expression()))
            if not self.accept(","):
                break
        return n.Update(table, tuple(out), self.expression() if self.accept("WHERE") else None)

    def delete(self):
        self.expect("FROM")
        return n.Delete(self.name(), self.expression() if self.accept("WHERE") else None)

    def assign(self):
        if self.now.kind != "variable":
            raise ParseError(f"expected a variable, found {self.now.text or 'the end'!r}", self.now.position)
        name = self.take().text[1:]
        self.expect("=")
        return n.Assign(name, self.expression())

    def grant(self, revoke: bool = False):
        t = self.take()
        if t.text.upper() not in PERMISSIONS or t.kind not in ("word", "keyword"):
            raise ParseError(f"unknown permission {t.text!r}", t.position)
        self.expect("ON")
        last = "FROM" if revoke else "TO"
        table = "" if self.now.is_(last) else self.name()
        self.expect(last)
        return n.Grant(t.text.upper(), table, self.name(), revoke)

    def revoke(self):
        return self.grant(True)


def parse_script(text: str, errors: list[ParseError] | None = None) -> list:
    """Statements of a script; ";" separates them, the last is optional. With a list for errors, a statement that does not parse is
    noted there and skipped up to the next ";"; without one, the first error is raised."""
    p, out = Parser(tokenize(text)), []
    while p.now.kind != "end":
        if p.accept(";"):
            continue
        try:
            out.append(p.statement())
        except ParseError as e:
            if errors is None:
                raise
            errors.append(e)
            while p.now.kind != "end" and not p.now.is_(";"):
                p.take()
    return out


def parse_expression(text: str):
    p = Parser(tokenize(text))
    e = p.expression()
    if p.now.kind != "end":
        raise ParseError(f"unexpected {p.now.text!r}", p.now.position)
    return e
