"""Ad-hoc SQL: what is refused, what a query reads, who may run it."""

import pytest
from pyspark.sql import functions as F

from tablewright.sources import guarded as g
from tablewright.sources.session import own_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def own(spark):
    return g.folder_session(spark, FOLDER, ["orders", "customer", "nation"])


@pytest.fixture
def table(spark, namespace):
    spark.sql(f"CREATE TABLE {namespace}.t USING parquet AS SELECT 1 AS a")
    return f"{namespace}.t"


def short(names):
    return [n.rsplit("/", 1)[-1].removesuffix(".parquet") for n in names]


@pytest.mark.parametrize("statement", [
    "INSERT INTO {t} VALUES (2)",
    "INSERT OVERWRITE {t} SELECT 3",
    "WITH x AS (SELECT 2 AS a) INSERT INTO {t} SELECT * FROM x",
    "FROM {t} INSERT INTO {t} SELECT a",
    "DROP TABLE {t}",
    "DROP TABLE {t} -- SELECT 1",
    "/* SELECT */ TRUNCATE TABLE {t}",
    "ALTER TABLE {t} RENAME TO {t}2",
    "CREATE TABLE {t}3 USING parquet AS SELECT 1 AS a",
    "CREATE TEMPORARY VIEW v AS SELECT 1",
    "CACHE TABLE {t}",
    "SET spark.sql.shuffle.partitions=3",
    "ADD JAR '/tmp/x.jar'",
    "REFRESH TABLE {t}",
    "SHOW TABLES",
    "CLEAR CACHE",
    "RESET spark.sql.ansi.enabled",
    "EXPLAIN SELECT 1",
    "DELETE FROM {t}",
    "SELECT 1) ; DROP TABLE {t} --",
    "BEGIN DROP TABLE {t}; END",
    "SELECT 1; SELECT 2",
    "",
])
def test_what_is_no_query_is_refused_and_does_nothing(spark, table, statement):
    with pytest.raises(g.NotReadOnly):
        g.read_only(spark, statement.format(t=table))
    assert [tuple(r) for r in spark.table(table).collect()] == [(1,)]
    assert not spark.catalog.tableExists(f"{table}3") and not spark.catalog.tableExists("v")


@pytest.mark.parametrize("statement", [
    "SELECT java_method('java.lang.System', 'lineSeparator') FROM {t}",
    "SELECT a FROM {t} WHERE a IN (SELECT CAST(reflect('java.lang.Integer', 'valueOf', '1') AS INT))",
    "SELECT TRANSFORM(a) USING 'cat' FROM {t}",
])
def test_queries_that_call_out_are_refused(spark, table, statement):
    with pytest.raises(g.NotReadOnly, match="cannot hold"):
        g.read_only(spark, statement.format(t=table))


@pytest.mark.parametrize("statement,read", [
    ("SELECT * FROM orders", ["orders"]),
    ("VALUES (1), (2)", []),
    ("FROM orders SELECT o_orderkey ORDER BY o_orderkey LIMIT 3 -- a comment", ["orders"]),
    ("WITH a AS (SELECT * FROM orders), b AS (SELECT o_custkey FROM a) SELECT * FROM b JOIN customer ON o_custkey = c_custkey", ["customer", "orders"]),
    ("SELECT (SELECT MAX(c_custkey) FROM customer) AS m, n_name FROM nation", ["customer", "nation"]),
    ("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey IN (SELECT o_custkey FROM orders))", ["customer", "nation", "orders"]),
    ("SELECT * FROM nation UNION ALL SELECT * FROM nation", ["nation"]),
    ("SELECT n_name FROM nation, LATERAL (SELECT COUNT(*) AS n FROM customer WHERE c_nationkey = n_nationkey)", ["customer", "nation"]),
    (f"SELECT * FROM parquet.`{FOLDER}/region.parquet`", ["region"]),
])
def test_queries_and_the_relations_they_read(own, statement, read):
    df = g.read_only(own, statement)
    assert short(g.relations_read(df)) == read
    assert df.collect() == own.sql(statement).collect()


def test_tables_and_views_over_them_are_listed_by_the_table(spark, table):
    spark.sql(f"CREATE VIEW {table}_v AS SELECT a + 1 AS b FROM {table}")
    df = g.read_only(spark, f"SELECT * FROM {table}_v")
    assert [n.removeprefix("spark_catalog.") for n in g.relations_read(df)] == [table]


def test_views_of_the_caller_are_not_overwritten(spark):
    spark.range(3).createOrReplaceTempView("orders")
    try:
        own = g.folder_session(spark, FOLDER, ["orders"])
        assert own.sql("SELECT COUNT(*) FROM orders").first()[0] == 1500
        assert spark.sql("SELECT COUNT(*) FROM orders").first()[0] == 3
    finally:
        spark.catalog.dropTempView("orders")
    assert own.sql("SELECT COUNT(*) FROM orders").first()[0] == 1500


def test_own_session_takes_over_settings_and_keeps_its_own(spark):
    own = own_session(spark, spark__sql__shuffle__partitions=3)
    assert own.conf.get("spark.sql.session.timeZone") == "UTC"
    assert (own.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.shuffle.partitions")) == ("3", "8")


GRANTS = [("readers", "table", "local.sales.orders", "select"), ("readers", "table", "local.sales.customer", "select")]


def test_only_what_the_principal_may_read(own):
    grants = own.createDataFrame(GRANTS, "group_name string, resource_type string, resource_path string, permission string")
    members = own.createDataFrame([("readers", "email", "carol")], "group_name string, kind string, principal string")
    names = {f"file:{FOLDER}/{t}.parquet": f"local.sales.{t}" for t in ("orders", "customer", "nation")}
    ask = lambda who, statement: g.authorised(own, statement, "email", who, grants, members, names)
    inside = "SELECT COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"
    assert ask("carol", inside).first()["n"] == 1500
    with pytest.raises(PermissionError, match=r"carol may not read local.sales.nation \(not_found\)"):
        ask("carol", "WITH n AS (SELECT * FROM nation) SELECT * FROM orders, n")
    with pytest.raises(PermissionError, match="erin"):
        ask("erin", inside)
    with pytest.raises(g.NotReadOnly):
        ask("carol", "DROP VIEW orders")
    assert ask("carol", "SELECT 1 AS one").first()["one"] == 1
    other = f"SELECT * FROM parquet.`{FOLDER}/region.parquet`"
    with pytest.raises(PermissionError, match="region"):
        ask("carol", other)


def test_requests_have_a_row_for_each_relation(own):
    df = g.read_only(own, "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey")
    found = g.requests_of(df, "email", 7).orderBy("request_id")
    assert [(r["principal"], r["action"], short([r["table_path"]])[0]) for r in found.collect()] == [(7, "read", "customer"), (7, "read", "orders")]
    assert g.requests_of(own.range(3).select(F.col("id")), "email", "a").count() == 0
