"""Tokens of a script."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import ParseError

KEYWORDS = frozenset(
    "CREATE DROP TABLE SELECT FROM WHERE GROUP ORDER BY LIMIT OFFSET ASC DESC AS INSERT INTO VALUES UPDATE SET DELETE GRANT REVOKE ON TO "
    "PRIMARY KEY NOT NULL UNIQUE AUTO_INCREMENT DEFAULT AND OR TRUE FALSE IS JOIN".split()
)
_TOKEN = re.compile(
    r"""(?P<blank>\s+)|(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<variable>@[^\W\d]\w*)|(?P<word>[^\W\d]\w*)|(?P<op>==|!=|<>|<=|>=|[-+*/%=<>(),;.])""",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, word, variable, number, string, op, end
    text: str
    position: int

    def is_(self, *texts: str) -> bool:
        return self.kind in ("keyword", "op") and self.text in texts


def tokenize(text: str) -> list[Token]:
    """Tokens of text and an end token. Keywords are upper-cased; strings lose their quotes and keep backslashes as they are."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError("unterminated string" if text[at] in "'\"" else f"unexpected character {text[at]!r}", at)
        kind, value = m.lastgroup, m.group()
        if kind == "word":
            if value.upper() in KEYWORDS:
                kind, value = "keyword", value.upper()
        elif kind == "string":
            value = value[1:-1]
        if kind != "blank":
            out.append(Token(kind, value, at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out


def token_frame(spark: SparkSession, text: str) -> DataFrame:
    """Tokens as rows (position, kind, text)."""
    return spark.createDataFrame([(t.position, t.kind, t.text) for t in tokenize(text)[:-1]], "position int, kind string, text string")
