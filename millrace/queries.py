"""Registered queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from . import functions as fn
from .engine import Engine
from .errors import EngineError
from .operators import integrity, permissions
from .operators import relational as rel
from .plans.lexer import token_frame
from .sources import storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ACL = "(VALUES ('u1','orders',3),('u1','',1),('u2','',127),('u3','orders',0),('u3','',127)) t(usr,tab,mask)"
FLAGSHIP = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice, o_orderkey LIMIT 10"


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    e = Engine(spark)
    e.register_folder(sf_dir, *names)
    return e


def statements(name: str, tables: str, text: str, sql: str) -> None:
    """A query that is text in the engine's own grammar; the last statement gives the result."""
    QUERIES[name] = lambda spark, d: engine(spark, d, *tables.split()).query(text)
    SQL[name] = sql


def api(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _same(name: str, table: str, text: str, sql: str | None = None) -> None:
    statements(name, table, text, sql or text)


_same("scan_all", "region", "SELECT * FROM region")
_same("project_columns", "orders", "SELECT o_orderkey, o_totalprice FROM orders")
_same("flagship", "orders", FLAGSHIP)
_same("filter_eq", "orders", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
_same("filter_eq_double", "orders", "SELECT * FROM orders WHERE o_orderstatus == 'F'")
_same("filter_ne", "orders", "SELECT * FROM orders WHERE o_orderstatus != 'F'")
_same("filter_lt", "orders", "SELECT * FROM orders WHERE o_totalprice < 50000")
_same("filter_le", "lineitem", "SELECT * FROM lineitem WHERE l_quantity <= 1")
_same("filter_gt", "lineitem", "SELECT * FROM lineitem WHERE l_quantity > 49")
_same("filter_ge", "lineitem", "SELECT * FROM lineitem WHERE l_quantity >= 49")
_same("filter_and", "lineitem", "SELECT * FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
_same("filter_or", "lineitem", "SELECT * FROM lineitem WHERE l_quantity >= 50 OR l_discount = 0.1")
_same("filter_not", "orders", "SELECT * FROM orders WHERE NOT o_orderstatus = 'F'")
_same("filter_precedence", "lineitem", "SELECT * FROM lineitem WHERE l_returnflag = 'R' OR l_returnflag = 'A' AND l_quantity < 2")
_same("filter_paren", "lineitem", "SELECT * FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') AND l_quantity < 2")
_same("filter_text_number", "part", "SELECT p_partkey FROM part WHERE p_brand != 5", "SELECT p_partkey FROM part WHERE p_brand <> '5'")
_same("arith_add_sub", "lineitem", "SELECT l_orderkey, l_quantity + l_tax AS a, l_quantity - l_discount AS b FROM lineitem")
_same("arith_mul", "lineitem", "SELECT l_orderkey, l_extendedprice * l_quantity AS m FROM lineitem")
_same("arith_div", "lineitem", "SELECT l_orderkey, l_extendedprice / l_quantity AS q FROM lineitem")
_same("arith_int_div", "lineitem", "SELECT l_orderkey, l_partkey / 7 AS q FROM lineitem", "SELECT l_orderkey, l_partkey // 7 AS q FROM lineitem")
_same("arith_mod", "lineitem", "SELECT l_orderkey, l_partkey % 7 AS r FROM lineitem")
_same("arith_negate", "lineitem", "SELECT l_orderkey, -(l_partkey - 2 * l_suppkey) AS r FROM lineitem", "SELECT l_orderkey, -(l_partkey - 2 * l_suppkey) AS r FROM lineitem")
_same("order_by_limit", "orders", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
_same("order_by_desc", "orders", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_same("limit_offset", "orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
_same("group_by_keys", "lineitem", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag")
_same("group_by_two_keys", "lineitem", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
statements("insert_values", "region", "INSERT INTO region VALUES (99, 'ATLANTIS'); SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT CAST(99 AS INTEGER), 'ATLANTIS'")
statements("insert_many", "region", "INSERT INTO region (r_name, r_regionkey) VALUES ('A', 98), ('B', 90 + 9); SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT CAST(98 AS INTEGER), 'A' UNION ALL SELECT CAST(99 AS INTEGER), 'B'")
statements("insert_partial_columns", "region", "INSERT INTO region (r_regionkey) VALUES (99); SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT CAST(99 AS INTEGER), NULL")
statements("update_where", "orders", "UPDATE orders SET o_orderstatus = 'DONE' WHERE o_orderstatus = 'F'; SELECT * FROM orders", "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
statements("update_all_rows", "orders", "UPDATE orders SET o_orderstatus = 'X'; SELECT * FROM orders", "SELECT * REPLACE ('X' AS o_orderstatus) FROM orders")
statements("update_multi_assign", "orders", "UPDATE orders SET o_orderstatus = 'B', o_orderpriority = '1-URGENT' WHERE o_totalprice > 400000; SELECT * FROM orders", "SELECT * REPLACE (CASE WHEN o_totalprice > 400000 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 400000 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority) FROM orders")
statements("update_expression", "orders", "UPDATE orders SET o_custkey = o_custkey + 1, o_orderkey = o_custkey WHERE o_orderkey % 2 = 0; SELECT * FROM orders", "SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END AS o_orderkey) FROM orders")
statements("update_adds_column", "nation", "UPDATE nation SET tag = 'A' WHERE n_regionkey = 0; SELECT * FROM nation", "SELECT *, CASE WHEN n_regionkey = 0 THEN 'A' END AS tag FROM nation")
statements("delete_where", "lineitem", "DELETE FROM lineitem WHERE l_returnflag = 'R'; SELECT * FROM lineitem", "SELECT * FROM lineitem WHERE (l_returnflag = 'R') IS NOT TRUE")
statements("delete_all", "region", "DELETE FROM region; INSERT INTO region VALUES (99, 'ATLANTIS'); SELECT * FROM region", "SELECT CAST(99 AS INTEGER) AS r_regionkey, 'ATLANTIS' AS r_name")
statements("join_statement", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name != 'ASIA'", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")


@api("join_equi", "SELECT n.*, r.* FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def join_equi(spark, d):
    return engine(spark, d, "nation", "region").join_tables("nation", "region", "n_regionkey = r_regionkey")


@api("join_theta", "SELECT n.*, r.* FROM nation n JOIN region r ON n_regionkey > r_regionkey")
def join_theta(spark, d):
    return engine(spark, d, "nation", "region").join_tables("nation", "region", lambda n, r: n.n_regionkey > r.r_regionkey)


@api("join_cross", "SELECT * FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return engine(spark, d, "nation", "region").join_tables("nation", "region", "TRUE")


@api("join_right_wins", "SELECT l.lang, r.* FROM documents l JOIN labels r ON l.doc_id = r.doc_id + 1")
def join_right_wins(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), spark.read.parquet(f"{d}/labels.parquet")
    return rel.join(docs, labels, lambda l, r: l.doc_id == r.doc_id + 1)


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


api("index_point", "SELECT * FROM orders WHERE o_orderkey = 42")(lambda s, d: rel.point(_read(s, d, "orders"), "o_orderkey", 42))
api("index_range", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200")(lambda s, d: rel.between(_read(s, d, "orders"), "o_orderkey", 100, 200))
api("index_keys", "SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL")(lambda s, d: rel.keys(_read(s, d, "orders"), "o_custkey"))
api("index_bounds", "SELECT min(CASE WHEN o_orderkey >= 100 THEN o_orderkey END) AS lb, min(CASE WHEN o_orderkey > 100 THEN o_orderkey END) AS ub FROM orders")(lambda s, d: rel.bounds(_read(s, d, "orders"), "o_orderkey", 100))
api("prefix_search", "SELECT * FROM part WHERE starts_with(p_name, 'cold')")(lambda s, d: rel.prefix(_read(s, d, "part"), "p_name", "cold"))
api("in_list_search", "SELECT * FROM orders WHERE o_orderkey IN (1, 5, 7)")(lambda s, d: rel.among(_read(s, d, "orders"), "o_orderkey", [1, 5, 7]))
api("udf_predicate", "SELECT * FROM nation WHERE n_nationkey % 2 = 0")(lambda s, d: engine(s, d, "nation").select("nation", lambda r: r.n_nationkey % 2 == 0))
api("validate_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: integrity.duplicates(_read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]))
api("validate_not_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL")(lambda s, d: integrity.nulls(_read(s, d, "documents").select("doc_id").join(_read(s, d, "labels"), "doc_id", "left"), ["quality"]).select("doc_id"))
api("fk_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: integrity.orphans(_read(s, d, "documents").select("doc_id"), "doc_id", _read(s, d, "labels"), "doc_id"))
api("validate_clean", "SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls, count(*) - count(DISTINCT o_orderkey) AS dups FROM orders")(lambda s, d: integrity.summary(_read(s, d, "orders"), "o_orderkey"))
api("acl_has_permission", f"SELECT usr, (coalesce(max(CASE WHEN tab = 'orders' THEN mask END), max(CASE WHEN tab = '' THEN mask END), 0) & 2) = 2 AS ok FROM {ACL} GROUP BY usr")(lambda s, d: permissions.allowed(s.sql(f"SELECT * FROM {ACL}"), "orders", 2))
api("acl_effective", f"SELECT usr, coalesce(max(CASE WHEN tab = 'orders' THEN mask END), max(CASE WHEN tab = '' THEN mask END), 0) AS mask FROM {ACL} GROUP BY usr")(lambda s, d: permissions.effective(s.sql(f"SELECT * FROM {ACL}"), "orders"))
api("acl_merge_grants", f"SELECT usr, bit_or(mask) AS mask FROM {ACL} GROUP BY usr")(lambda s, d: permissions.merged(s.sql(f"SELECT * FROM {ACL}")))
api("vector_add", "SELECT vec_id, list_transform(embedding, lambda x: x + x) AS v FROM embeddings")(lambda s, d: _read(s, d, "embeddings").select("vec_id", fn.vector_add(F.col("embedding"), F.col("embedding")).alias("v")))
api("vector_mul", "SELECT vec_id, list_transform(embedding, lambda x: x * x) AS v FROM embeddings")(lambda s, d: _read(s, d, "embeddings").select("vec_id", fn.vector_mul(F.col("embedding"), F.col("embedding")).alias("v")))
api("hash_digest", "SELECT c_custkey, sha256(c_name) AS h FROM customer")(lambda s, d: _read(s, d, "customer").select("c_custkey", fn.digest(F.col("c_name")).alias("h")))
api("encrypt_roundtrip", "SELECT c_custkey, c_name FROM customer")(lambda s, d: storage.opened(storage.sealed(_read(s, d, "customer").select("c_custkey", "c_name"), ["c_name"], "0000111122223333"), ["c_name"], "0000111122223333"))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, in a session of one process without it, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise EngineError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    return f"{base}/engine-{uuid.uuid4().hex}"


@api("export_csv_roundtrip", "SELECT doc_id, text, lang FROM documents")
def export_csv_roundtrip(spark, d):
    df, path = _read(spark, d, "documents").select("doc_id", "text", "lang"), _folder(spark)
    storage.export_csv(df, path)
    return storage.read_csv(spark, path, df.schema)


@api("export_json_roundtrip", "SELECT doc_id, text, lang FROM documents")
def export_json_roundtrip(spark, d):
    df, path = _read(spark, d, "documents").select("doc_id", "text", "lang"), _folder(spark)
    storage.export_json(df, path)
    return storage.read_json(spark, path, df.schema)


@api("commit_open_roundtrip", "SELECT * FROM orders WHERE o_orderkey > 10")
def commit_open_roundtrip(spark, d):
    path = _folder(spark)
    e = engine(spark, d, "orders")
    e.add_index("orders", "o_orderkey")
    e.query("DELETE FROM orders WHERE o_orderkey <= 10")
    e.commit(path)
    return Engine(spark, path).table("orders")


@api("hello_script", "SELECT '' AS phrase WHERE false")
def hello_script(spark, d):
    return Engine(spark).query("CREATE TABLE hello (phrase TEXT); INSERT INTO hello (phrase) VALUES ('Well, good day!'); UPDATE hello SET phrase = 'So long!' WHERE phrase = 'Well, good day!'; DELETE FROM hello WHERE phrase = 'So long!'; SELECT * FROM hello")


@api("create_drop_script", "SELECT * FROM (VALUES (1, 'a', 5), (2, NULL, 5)) t(id, name, n)")
def create_drop_script(spark, d):
    return Engine(spark).query("CREATE TABLE t (id INT); DROP TABLE t; DROP TABLE t; CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(20), n INT DEFAULT 5); INSERT INTO t (id, name) VALUES (1, 'a'); INSERT INTO t (id) VALUES (2); SELECT * FROM t")


@api("grant_revoke_script", "SELECT * FROM (VALUES ('ann', 'orders', 1), ('ann', '', 2), ('bob', 'orders', 0)) t(usr, tab, mask)")
def grant_revoke_script(spark, d):
    e = Engine(spark)
    e.query("GRANT SELECT ON orders TO ann; GRANT INSERT ON TO ann; GRANT ALL ON orders TO bob; REVOKE ALL ON orders FROM bob")
    return spark.createDataFrame([(u, t, m) for u, own in e.users.acl.items() for t, m in own.items()], "usr string, tab string, mask int")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


def _outcomes(e: Engine, *texts: str) -> list[tuple[int, str]]:
    """(number, ok or the kind of error) of each text."""
    out = []
    for i, text in enumerate(texts):
        try:
            e.query(text)
            out.append((i, "ok"))
        except EngineError as x:
            out.append((i, type(x).__name__))
    return out


def _printed(spark: SparkSession, *runs: list[str], stdin: str = "") -> DataFrame:
    """Lines that the command line prints."""
    out = io.StringIO()
    for argv in runs:
        cli.main(argv, spark, out, io.StringIO(stdin))
    return _rows(spark, list(enumerate(out.getvalue().splitlines())), "no int, line string")


def _file(text: str) -> str:
    """A script file of the driver."""
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "script.sql")
    with open(path, "w") as f:
        f.write(text)
    return path


TOKENS = "SELECT a FROM t WHERE b >= 'x y';"
SMALL = "CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2); SELECT a FROM t WHERE a > 1"

api("tokenize_script", _values("position, kind, text", "(0, 'keyword', 'SELECT')", "(7, 'word', 'a')", "(9, 'keyword', 'FROM')", "(14, 'word', 't')", "(16, 'keyword', 'WHERE')", "(22, 'word', 'b')", "(24, 'op', '>=')", "(27, 'string', 'x y')", "(32, 'op', ';')"))(lambda s, d: token_frame(s, TOKENS))
api("compile_script", _values("step, kind, plan", "(0, 'Drop', 'Drop(table=''t'')')", "(1, 'Delete', 'Delete(table=''t'', where=Binary(op=''='', left=Name(name=''a''), right=Literal(value=1, text=''1'')))')"))(lambda s, d: Engine(s).compile("DROP TABLE t; DELETE FROM t WHERE a = 1"))
api("syntax_check", _values("position", "(0)", "(25)"))(lambda s, d: _rows(s, [(e.position,) for e in Engine.check("SELEC a FROM t; SELECT a FRO t; DROP TABLE t")], "position int"))
api("script_file", _values("no, line", "(0, 'a')", "(1, '2')"))(lambda s, d: _printed(s, ["-s", _file(SMALL), "-m"]))
api("inline_text", _values("no, line", "(0, 'a')", "(1, '2')"))(lambda s, d: _printed(s, ["-q", SMALL]))
api("prompt_session", _values("no, line", "(0, 'a')", "(1, '2')", "(2, 'error: no table u')"))(lambda s, d: _printed(s, ["-r"], stdin=f"{SMALL}\nDROP TABLE t\nSELECT a FROM u\nexit\nSELECT a FROM v\n"))
api("help_text", _values("shown", "(true)"))(lambda s, d: _printed(s, []).filter("line LIKE 'usage: millrace%'").selectExpr("true AS shown"))
api("unknown_statement", _values("no, line", "(0, 'a')", "(1, '1')", "(2, 'error: unknown statement ''FROBNICATE'' (at 0)')"))(lambda s, d: _printed(s, ["-q", "FROBNICATE t; CREATE TABLE t (a INT); INSERT INTO t VALUES (1); SELECT a FROM t"]))


@api("compiled_program", _values("no, line", "(0, 'a')", "(1, '2')"))
def compiled_program(spark, d):
    plan = _file("")
    return _printed(spark, ["-cc", _file(SMALL), "-o", plan], ["-fb", plan])


@api("in_memory_mode", _values("no, line", "(0, 'a')", "(1, '2')", "(2, 'error: no table t')"))
def in_memory_mode(spark, d):
    path = _folder(spark)
    return _printed(spark, ["-m", "-d", path, "-q", SMALL], ["-d", path, "-q", "SELECT a FROM t"])


@api("list_tables", _values("tab", "('nation')", "('region')", "('t')"))
def list_tables(spark, d):
    e = engine(spark, d, "region", "nation")
    e.query("CREATE TABLE t (a INT); CREATE TABLE u (a INT); DROP TABLE u")
    return _rows(spark, [(t,) for t in e.tables()], "tab string")


@api("database_path", _values("before, after, reopened", "(false, true, true)"))
def database_path(spark, d):
    path, e = _folder(spark), engine(spark, d, "region")
    before = e.path is not None
    e.commit(path)
    return _rows(spark, [(before, e.path == path, Engine(spark, path).path == path)], "before boolean, after boolean, reopened boolean")


@api("second_commit", "SELECT * FROM region WHERE r_regionkey <> 1")
def second_commit(spark, d):
    path, e = _folder(spark), engine(spark, d, "region")
    e.commit(path)
    e.query("DELETE FROM region WHERE r_regionkey = 1")
    e.commit()
    e.query("DELETE FROM region")  # not committed
    return Engine(spark, path).table("region")


@api("encrypted_database", "SELECT * FROM orders WHERE o_orderkey > 10")
def encrypted_database(spark, d):
    path, e = _folder(spark), engine(spark, d, "orders")
    e.key = "0000111122223333"
    e.query("DELETE FROM orders WHERE o_orderkey <= 10")
    e.commit(path)
    return Engine(spark, path, key=e.key).table("orders")


@api("two_indexes", "SELECT * FROM orders WHERE o_custkey = 37")
def two_indexes(spark, d):
    path, e = _folder(spark), engine(spark, d, "orders")
    e.add_index("orders", "o_orderkey")
    e.add_index("orders", "o_custkey")
    e.commit(path)
    return rel.point(Engine(spark, path).table("orders"), "o_custkey", 37)


@api("index_removed", "SELECT 0 AS indexes, count(*) AS n FROM orders")
def index_removed(spark, d):
    e = engine(spark, d, "orders")
    e.add_index("orders", "o_orderkey")
    e.remove_index("orders", "o_orderkey")
    return e.table("orders").agg(F.lit(len(e.catalog.get("orders").indexes)).alias("indexes"), F.count("*").alias("n"))


@api("foreign_key_check", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def foreign_key_check(spark, d):
    e = engine(spark, d, "documents", "labels")
    e.add_foreign_key("documents", "doc_id", "labels", "doc_id")
    return e.check_foreign_keys("documents")["doc_id"].select("doc_id")


KEYED = "CREATE TABLE t (id INT PRIMARY KEY, email TEXT UNIQUE, name TEXT NOT NULL, no INT AUTO_INCREMENT); INSERT INTO t (id, email, name) VALUES (1, 'a', 'x'), (2, NULL, 'y')"


@api("validate_row", "SELECT * FROM (VALUES ('NOT NULL', 'name', NULL, 1), ('UNIQUE', 'id', '1', 2), ('UNIQUE', 'email', 'a', 2)) t(\"constraint\", column_name, value, n)")
def validate_row(spark, d):
    e = Engine(spark)
    e.query(KEYED)
    return e.validate_rows("t", [(1, "a", None, 9)]).withColumn("n", F.col("n").cast("int"))


api("violations", """SELECT 'UNIQUE' AS "constraint", 'l_orderkey' AS column_name, CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")(lambda s, d: integrity.violations(_read(s, d, "lineitem"), ["l_orderkey", "l_quantity"], ["l_orderkey"]))
api("auto_increment", _values("id, no", "(1, 1)", "(2, 2)", "(7, 3)"))(lambda s, d: Engine(s).query(f"{KEYED}; INSERT INTO t (id, email, name) VALUES (7, NULL, 'z'); SELECT id, no FROM t"))


@api("constraints_kept", _values("no, outcome", "(0, 'ConstraintViolation')", "(1, 'ConstraintViolation')", "(2, 'ConstraintViolation')", "(3, 'ok')", "(4, 'ConstraintViolation')", "(5, 'ok')"))
def constraints_kept(spark, d):
    e = Engine(spark)
    e.query(KEYED)
    insert = "INSERT INTO t (id, email, name) VALUES "
    return _rows(spark, _outcomes(e, f"{insert} (1, 'b', 'x')", f"{insert} (3, 'a', 'x')", f"{insert} (3, 'b', NULL)", f"{insert} (3, 'b', 'x')", "UPDATE t SET id = 1 WHERE id = 3", "UPDATE t SET id = 9 WHERE id = 3"), "no int, outcome string")


def _with_users(spark: SparkSession, d: str, *tables: str) -> Engine:
    e = engine(spark, d, *tables)
    for name in ("root", "ann"):
        e.add_user(name, f"pw of {name}")
    e.set_owner("root")
    return e


@api("users_login", _values("what, ok", "('wrong password', false)", "('unknown user', false)", "('right password', true)", "('logged in', true)", "('logged out', false)", "('removed user', false)"))
def users_login(spark, d):
    u = _with_users(spark, d).users
    out = [("wrong password", u.login("ann", "no")), ("unknown user", u.login("bob", "")), ("right password", u.login("ann", "pw of ann")), ("logged in", u.authenticated and u.current == "ann")]
    u.logout()
    out.append(("logged out", u.authenticated))
    u.remove("ann")
    return _rows(spark, [*out, ("removed user", u.login("ann", "pw of ann"))], "what string, ok boolean")


@api("password_salts", _values("salts_differ, hashes_differ, plain_kept", "(true, true, false)"))
def password_salts(spark, d):
    u = permissions.Users()
    u.add("a", "same")
    u.add("b", "same")
    (s, h), (t, k) = u.secrets["a"], u.secrets["b"]
    return _rows(spark, [(s != t, h != k, b"same" in h + k + s + t)], "salts_differ boolean, hashes_differ boolean, plain_kept boolean")


@api("owner_rights", _values("usr, no, outcome", *[f"('ann', {i}, '{x}')" for i, x in enumerate(["PermissionDenied"] * 5 + ["ok", "PermissionDenied", "PermissionDenied"])], *[f"('root', {i}, 'ok')" for i in range(8)]))
def owner_rights(spark, d):
    """What a user with INSERT and UPDATE, and then the owner, may do."""
    e, out = _with_users(spark, d, "region", "nation"), []
    e.query("GRANT INSERT ON region TO ann; GRANT UPDATE ON region TO ann")
    for who in ("ann", "root"):
        e.users.set_current(who)
        tried = _outcomes(e, "GRANT ALL ON region TO ann", "REVOKE INSERT ON region FROM ann", "CREATE TABLE t (a INT)", "DROP TABLE nation", "SELECT * FROM region", f"INSERT INTO region VALUES ({len(out)}, 'X')", "UPDATE region SET r_name = 'Y' WHERE r_regionkey = 1", "DELETE FROM region")
        out += [(who, i, x) for i, x in tried]
    return _rows(spark, out, "usr string, no int, outcome string")


@api("restricted_view", "SELECT n_nationkey, n_name, CAST(NULL AS INTEGER) AS n_regionkey FROM nation WHERE n_regionkey = 1")
def restricted_view(spark, d):
    e = _with_users(spark, d, "nation")
    e.query("GRANT SELECT ON nation TO ann")
    e.restrict("ann", "nation", "n_regionkey = 1", ["n_nationkey", "n_name"])
    e.users.login("ann", "pw of ann")
    return e.query("SELECT * FROM nation").select("n_nationkey", "n_name", "n_regionkey")


@api("audit_log", _values("usr, statement, tab, outcome", "(NULL, 'Grant', 'region', 'ok')", "('ann', 'Select', 'region', 'ok')", "('ann', 'Delete', 'region', 'PermissionDenied')", "('ann', 'Select', 'nowhere', 'MissingTable')"))
def audit_log(spark, d):
    e = _with_users(spark, d, "region")
    e.query("GRANT SELECT ON region TO ann")
    e.users.set_current("ann")
    _outcomes(e, "SELECT * FROM region", "DELETE FROM region", "SELECT a FROM nowhere")
    return e.audited().drop("at")


statements("session_variables", "nation", "SET @a = 2 + 3; SET @b = @a - 4; SELECT * FROM nation WHERE n_regionkey = @b", "SELECT * FROM nation WHERE n_regionkey = 1")


@api("step_and_reset", _values("no, seen, tables", "(0, NULL, 1)", "(1, NULL, 1)", "(2, 1, 1)", "(3, NULL, 0)"))
def step_and_reset(spark, d):
    e = Engine(spark)
    out = [(i, None if r is None else r.count(), len(e.tables())) for i, (_, r) in enumerate(e.steps(SMALL))]
    e.reset()
    return _rows(spark, [*out, (len(out), None, len(e.tables()))], "no int, seen int, tables int")


def _new_regions(s: SparkSession) -> DataFrame:
    return s.sql("SELECT CAST(key AS INT) AS r_regionkey, name AS r_name FROM VALUES (1, 'ONE'), (99, 'NEW') AS t(key, name)")


api("map_insert", "SELECT * FROM region WHERE r_regionkey <> 1 UNION ALL SELECT CAST(1 AS INTEGER), 'ONE' UNION ALL SELECT CAST(99 AS INTEGER), 'NEW'")(lambda s, d: rel.upsert(_read(s, d, "region"), "r_regionkey", _new_regions(s)))
api("map_get", "SELECT * FROM region WHERE r_regionkey = 3")(lambda s, d: rel.point(_read(s, d, "region"), "r_regionkey", 3))
api("map_remove", "SELECT * FROM region WHERE r_regionkey <> 1")(lambda s, d: rel.remove(_read(s, d, "region"), "r_regionkey", _new_regions(s).select("r_regionkey")))
api("join_rows_predicate", "SELECT n.*, r.* FROM nation n JOIN region r ON n_regionkey = r_regionkey AND length(n_name) > length(r_name)")(lambda s, d: rel.join_rows(_read(s, d, "nation"), _read(s, d, "region"), lambda n, r: n.n_regionkey == r.r_regionkey and len(n.n_name) > len(r.r_name)))
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {}), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
api("fnv_hash", f"""SELECT c_custkey, {_FNV.format("list_transform(range(0, 8), lambda i: (CAST(c_custkey AS BIGINT) >> CAST(8 * i AS INTEGER)) & 255)")} AS of_key,
  {_FNV.format("list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS BIGINT))")} AS of_name FROM customer""")(lambda s, d: _read(s, d, "customer").select("c_custkey", fn.fnv1a_long(F.col("c_custkey")).alias("of_key"), fn.fnv1a(F.col("c_name")).alias("of_name")))
