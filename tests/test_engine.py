import io

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace import cli, streaming
from millrace.engine import Engine
from millrace.errors import ConstraintViolation, EngineError, MissingTable, PermissionDenied, TableExists
from millrace.operators import changes, integrity
from millrace.operators import relational as rel
from millrace.sources import storage


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("n", spark.createDataFrame([(1, "a", 1.5), (2, "", None), (None, None, 2.0), (4, "NULL", -1.0)], "k int, v string, x double"))
    return e


def test_unknown_is_not_true(engine):
    assert rows(engine.query("SELECT k FROM n WHERE x > 0")) == [(1,), (None,)]
    assert rows(engine.query("SELECT k FROM n WHERE NOT x > 0")) == [(4,)]
    engine.query("DELETE FROM n WHERE x > 1.7")
    assert rows(engine.query("SELECT k FROM n")) == [(1,), (2,), (4,)]
    engine.query("UPDATE n SET v = 'z' WHERE x < 0")
    assert rows(engine.query("SELECT k, v FROM n WHERE v IS NOT NULL")) == [(1, "a"), (2, ""), (4, "z")]


def test_text_against_number(engine):
    engine.query("CREATE TABLE t (s TEXT); INSERT INTO t VALUES ('1'), ('01'), ('x')")
    assert rows(engine.query("SELECT s FROM t WHERE s = 1")) == [("1",)]


def test_updates_see_old_rows(engine):
    engine.query("CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 2); UPDATE t SET a = b, b = a, c = a + b")
    assert rows(engine.query("SELECT * FROM t")) == [(2, 1, 3)]


def test_integer_arithmetic(engine):
    engine.query("CREATE TABLE t (a BIGINT, b BIGINT); INSERT INTO t VALUES (-7, 2), (7, -2)")
    assert rows(engine.query("SELECT a / b AS q, a % b AS r FROM t")) == [(-3, -1), (-3, 1)]
    with pytest.raises(Exception, match="(?i)zero"):
        engine.query("SELECT a / 0 AS q FROM t").collect()


def test_constraints(engine):
    engine.query("CREATE TABLE t (id INT PRIMARY KEY, email TEXT UNIQUE, name TEXT NOT NULL, no INT AUTO_INCREMENT)")
    engine.query("INSERT INTO t (id, email, name) VALUES (1, 'a', 'x'), (2, NULL, 'y'), (3, NULL, 'y')")
    for bad in ("(NULL, 'b', 'x')", "(1, 'b', 'x')", "(4, 'a', 'x')", "(4, 'b', NULL)", "(5, 'q', 'x'), (5, 'r', 'x')"):
        with pytest.raises(ConstraintViolation):
            engine.query(f"INSERT INTO t (id, email, name) VALUES {bad}")
    with pytest.raises(ConstraintViolation):
        engine.query("UPDATE t SET id = 1")
    assert rows(engine.query("SELECT id, no FROM t")) == [(1, 1), (2, 2), (3, 3)]
    assert engine.validate_rows("t", [(1, "a", None, 1)]).count() == 3
    engine.insert("t", [(1, "a", "x", 9)], validate=False)
    assert rows(integrity.duplicates(engine.table("t"), ["id"])) == [(1, 2)]


def test_errors(engine):
    with pytest.raises(MissingTable):
        engine.query("SELECT a FROM nowhere")
    with pytest.raises(TableExists):
        engine.query("CREATE TABLE n (a INT)")
    with pytest.raises(EngineError):
        engine.query("SELECT nothing FROM n")
    with pytest.raises(EngineError):
        engine.query("INSERT INTO n VALUES (1)")
    with pytest.raises(EngineError):
        engine.query("SELECT v FROM n GROUP BY k")
    got = engine.script("SELEC x; SELECT k FROM n; DELETE FROM nowhere")
    assert sum(isinstance(r, Exception) for _, r in got) == 2 and rows(got[0][1])


def test_join_keeps_the_right_value(spark, engine):
    engine.register("l", spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "y", 3)], "id int, name string, a int"))
    engine.register("r", spark.createDataFrame([(2, "Y", 7), (2, "Z", 8), (9, "N", 9)], "id int, name string, b int"))
    got = engine.join_tables("l", "r", lambda l, r: l.id == r.id)
    assert got.columns == ["a", "id", "name", "b"]
    assert rows(got) == [(2, 2, "Y", 7), (2, 2, "Z", 8), (3, 2, "Y", 7), (3, 2, "Z", 8)]
    assert rows(engine.query("SELECT a, b FROM l JOIN r ON a < b WHERE b = 7")) == [(1, 7), (2, 7), (3, 7)]


def test_permissions(spark):
    e = Engine(spark)
    e.query("CREATE TABLE t (a INT)")
    e.add_user("ann", "pw")
    e.add_user("root", "other")
    with pytest.raises(EngineError):
        e.set_owner("nobody")
    e.set_owner("root")
    e.query("GRANT SELECT ON TO ann; GRANT INSERT ON t TO ann")
    assert not e.users.login("ann", "no") and e.users.login("ann", "pw")
    with pytest.raises(PermissionDenied):  # the table's entry hides the global one
        e.query("SELECT * FROM t")
    e.query("INSERT INTO t VALUES (1)")
    for text in ("GRANT SELECT ON t TO ann", "REVOKE INSERT ON t FROM ann", "CREATE TABLE u (a INT)", "DROP TABLE t"):
        with pytest.raises(PermissionDenied):
            e.query(text)
    for act in (lambda: e.add_index("t", "a"), lambda: e.remove_index("t", "a"), lambda: e.commit("x"), lambda: e.load("x"), lambda: e.add_user("eve", "x"), lambda: e.set_owner("ann"), lambda: e.restrict("ann", "t"), lambda: e.validate_rows("t", [(1,)]), lambda: e.register("v", spark.range(1)), lambda: e.check_foreign_keys("t")):
        with pytest.raises(PermissionDenied):
            act()
    e.users.set_current("root")
    e.query("GRANT SELECT ON t TO ann; GRANT UPDATE ON t TO ann")
    e.users.set_current("ann")
    assert e.query("SELECT * FROM t").count() == 1
    e.query("UPDATE t SET a = a + 1 WHERE a = 1")
    with pytest.raises(PermissionDenied):
        e.query("DELETE FROM t")
    e.users.set_current("root")
    e.query("REVOKE SELECT ON t FROM ann")
    e.users.set_current("ann")
    for text in ("UPDATE t SET a = 5 WHERE a = 2", "UPDATE t SET a = a + 1"):  # they would tell what is there
        with pytest.raises(PermissionDenied):
            e.query(text)
    e.query("UPDATE t SET a = 5")
    e.users.set_current("root")
    e.query("REVOKE ALL ON t FROM ann")
    assert e.users.acl["ann"]["t"] == 0 and not e.users.has("ann", 1, "t") and e.users.has("root", 127, "t")
    e.users.logout()
    assert not e.users.authenticated


def test_row_and_column_permissions(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    e.query("CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, 'y'), (3, 'z')")
    e.add_user("ann", "pw")
    e.query("GRANT ALL ON t TO ann")
    e.restrict("ann", "t", "a > 1", ["a"])
    e.commit()
    f = Engine(spark, path)
    assert f.users.login("ann", "pw") and rows(f.query("SELECT * FROM t WHERE b = 'y' OR a = 3")) == [(3, None)]
    for text in ("DELETE FROM t", "UPDATE t SET a = 1"):
        with pytest.raises(PermissionDenied):
            f.query(text)
    f.users.logout()
    assert f.table("t").count() == 3


def test_commits_are_whole(spark, tmp_path):
    """A commit that does not get to its manifest changes nothing; of two at a time, one fails; a key is needed where one was used."""
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    e.query("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    e.commit()
    f, kept = Engine(spark, path), storage.write_text
    f.query("INSERT INTO t VALUES (2)")
    storage.write_text = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            f.commit()
    finally:
        storage.write_text = kept
    assert rows(Engine(spark, path).table("t")) == [(1,)]
    f.commit()
    assert rows(Engine(spark, path).table("t")) == [(1,), (2,)] and storage.manifests(spark, path) == [1, 2]
    with pytest.raises(OSError):
        kept(spark, f"{path}/manifest-2.json", "{}")
    sealed = Engine(spark, f"{path}2", key="k" * 16)
    sealed.register("s", spark.sql("SELECT 1 AS i, 'secret text' AS s, 0.1D AS d, array(1, NULL) AS l, TIMESTAMP '2024-05-06 07:08:09.123456' AS ts, CAST(NULL AS STRING) AS n, CAST('NaN' AS DOUBLE) AS q"))
    want = [str(r) for r in sealed.table("s").collect()]
    sealed.commit()
    assert [str(r) for r in Engine(spark, f"{path}2", key="k" * 16).table("s").collect()] == want
    assert not any(b"secret text" in f.read_bytes() for f in tmp_path.rglob("db2/**/*.parquet"))
    with pytest.raises(EngineError):
        Engine(spark, f"{path}2")


def test_no_job_without_constraints(spark):
    """Changes of tables without constraints only extend a plan."""
    e = Engine(spark)
    e.register("r", spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    spark.sparkContext.setJobGroup("changes", "")
    e.query("UPDATE r SET r_name = 'X' WHERE r_regionkey = 1; DELETE FROM r WHERE r_regionkey = 2; INSERT INTO r VALUES (9, 'N')")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("changes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert e.table("r").count() == 5


def test_commit_and_open(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    text = ["", "a b\n\tc", "q\"'\\", "nul\0x", "é😀,"]
    e.query("CREATE TABLE t (s TEXT UNIQUE, n INT DEFAULT 7); CREATE TABLE p (n INT)")
    e.insert("t", [(x,) for x in text], ("s",))
    e.add_foreign_key("t", "n", "p", "n")
    e.add_index("t", "s")
    e.users.add("u", "pw")
    e.users.grant("u", 3, "t")
    e.commit()
    f = Engine(spark, path)
    assert sorted(r.s for r in f.table("t").collect()) == sorted(text)
    assert f.users.login("u", "pw") and f.users.mask("u", "t") == 3
    f.users.logout()
    assert f.check_foreign_keys("t")["n"].count() == 5
    with pytest.raises(ConstraintViolation):
        f.query("INSERT INTO t (s) VALUES ('')")
    f.query("INSERT INTO t (s) VALUES ('new'); DELETE FROM t WHERE s = ''")
    f.commit()
    assert Engine(spark, path).table("t").filter("n = 7").count() == 5


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb,\"c\""), (2, ""), (3, None), (4, " x ")], "i int, s string")
    storage.export_csv(df, f"{tmp_path}/c")
    storage.export_json(df, f"{tmp_path}/j")
    assert rows(storage.read_csv(spark, f"{tmp_path}/c", df.schema)) == rows(df) == rows(storage.read_json(spark, f"{tmp_path}/j", df.schema))
    assert rows(storage.opened(storage.sealed(df, ["s"], "k" * 16), ["s"], "k" * 16)) == rows(df)


def test_push_down(spark, engine):
    engine.register_folder("/root/testdata/sf0.001", "orders")
    plan = engine.explain("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 3")
    assert "PushedFilters: [" in plan and "GreaterThan(o_totalprice" in plan and "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_command_line(spark, tmp_path):
    script = tmp_path / "s.sql"
    script.write_text("CREATE TABLE t (a INT); INSERT INTO t VALUES (1); SELECT a FROM t")
    out = io.StringIO()
    assert cli.main(["-c", str(script)], out=out) == 0
    assert cli.main(["-cc", str(script), "-o", str(tmp_path / "p")], out=out) == 0
    assert cli.main(["-fb", str(tmp_path / "p")], spark, out) == 0
    assert cli.main(["-s", str(script), "-d", f"file://{tmp_path}/db"], spark, out) == 0
    assert cli.main(["-q", "SELECT a FROM t", "-d", f"file://{tmp_path}/db"], spark, out) == 0
    assert cli.main(["-q", "SELECT a FROM"], spark, out) == 1
    assert out.getvalue().split("\n")[:7] == ["OK", "a", "1", "a", "1", "a", "1"]


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (2, -2.0)], "k int, x double").write.parquet(f"{tmp_path}/in")
    s = streaming.follow(spark, f"{tmp_path}/in", "k int, x double", "x > 0", ("k", "x * 2 AS y"))
    streaming.append(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1, 4.0)]


def test_long_history(spark):
    e = Engine(spark)
    e.query("CREATE TABLE t (a INT); INSERT INTO t VALUES (0)")
    for _ in range(12):
        e.query("UPDATE t SET a = a + 1")
    assert rows(e.table("t")) == [(12,)]


leaf = st.sampled_from(["a", "b", "3", "-2", "a + b", "b * 2", "a - 1"])
test_ = st.tuples(leaf, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), leaf).map(" ".join)
tree = st.recursive(test_, lambda t: st.one_of(st.tuples(t, st.sampled_from(["AND", "OR"]), t).map(lambda x: f"({x[0]}) {x[1]} ({x[2]})"), t.map(lambda x: f"NOT ({x})")), max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree)
def test_predicates_like_duckdb(spark, text):
    data = [(1, 2), (3, 3), (-2, None), (None, 0), (None, None), (0, -2)]
    df = spark.createDataFrame(data, "a int, b int")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a INT, b INT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", data)
    assert rows(rel.where(df, text)) == sorted(con.execute(f"SELECT * FROM t WHERE {text}").fetchall(), key=str)
    assert rows(changes.delete(df, text)) == sorted(con.execute(f"SELECT * FROM t WHERE ({text}) IS NOT TRUE").fetchall(), key=str)
