import pytest

from millrace.engine import Engine
from millrace.errors import ParseError
from millrace.plans import nodes as n
from millrace.plans.lexer import tokenize
from millrace.plans.parser import parse_expression, parse_script


def shape(e):
    if isinstance(e, n.Binary):
        return f"({shape(e.left)}{e.op}{shape(e.right)})"
    if isinstance(e, n.Not):
        return f"!{shape(e.value)}"
    if isinstance(e, n.Negate):
        return f"-{shape(e.value)}"
    return e.name if isinstance(e, n.Name) else e.text


@pytest.mark.parametrize(
    "text,want",
    [
        ("a OR b AND c", "(aOR(bANDc))"),
        ("NOT a = b AND c", "(!(a=b)ANDc)"),
        ("a = b < c", "(a=(b<c))"),
        ("a - b - c * d % e", "((a-b)-((c*d)%e))"),
        ("a == b", "(a=b)"),
        ("a <> b", "(a!=b)"),
        ("-a * (b + 2.5)", "(-a*(b+2.5))"),
        ("NOT NOT a", "!!a"),
    ],
)
def test_precedence(text, want):
    assert shape(parse_expression(text)) == want


def test_tokens():
    assert [(t.kind, t.text) for t in tokenize("""select 'a\\'b' , "c" x_1 1.5""")] == [("keyword", "SELECT"), ("string", "a\\'b"), ("op", ","), ("string", "c"), ("word", "x_1"), ("number", "1.5"), ("end", "")]


@pytest.mark.parametrize("text", ["SELECT", "SELECT a", "SELECT a FROM", "INSERT INTO t VALUES (1", "UPDATE t SET", "DELETE t", "GRANT FLY ON t TO u", "GRANT SELECT t TO u", "CREATE TABLE t ()", "CREATE TABLE t (a INT, A INT)", "SELECT a FROM t LIMIT x", "SELECT 'a FROM t", "SELECT a FROM t nonsense", "SELECT a ! b FROM t", "frobnicate"])
def test_errors_have_positions(text):
    with pytest.raises(ParseError) as e:
        parse_script(text)
    assert e.value.position >= 0


def test_statements():
    assert parse_script(";;") == [] == parse_script("")
    assert parse_script("select a, b from t where a = 1 group by a order by a desc limit 2 offset 3")[0] == n.Select("t", ((n.Name("a"), None), (n.Name("b"), None)), n.Binary("=", n.Name("a"), n.Literal(1, "1")), ("a",), (("a", True),), 2, 3)
    assert len(parse_script("UPDATE t SET a = 1; DELETE FROM t")) == 2
    assert parse_script("GRANT ALL ON TO u; REVOKE DELETE ON t FROM u") == [n.Grant("ALL", "", "u"), n.Grant("DELETE", "t", "u", True)]
    assert parse_script("INSERT INTO t VALUES (1, 'a'), (2, NULL)")[0].rows[1][1].value is None


def test_recovery():
    errors = Engine.check("SELECT a FROM t; SELEC b; DELETE FROM t WHERE; DELETE FROM t")
    assert len(errors) == 2
