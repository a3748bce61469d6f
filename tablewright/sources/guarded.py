"""Ad-hoc SQL that can only read, and only what its author may read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.access import check_access
from tablewright.sources.parquet import scan
from tablewright.sources.session import own_session

CATALYST = "org.apache.spark.sql.catalyst"
SUBQUERY = f"{CATALYST}.expressions.PlanExpression"
# What a query's plan can hold that does more than read.
REFUSED = [
    f"{CATALYST}.plans.logical.Command",
    f"{CATALYST}.plans.logical.ScriptTransformation",
    f"{CATALYST}.expressions.CallMethodViaReflection",
]


class NotReadOnly(ValueError):
    """A statement that is no query, or a query that would change something."""


def _elements(found: JavaObject) -> Iterator[JavaObject]:
    """Of a Scala collection, one by one."""
    each = found.iterator()
    while each.hasNext():
        yield each.next()


def _instance(spark: SparkSession, thing: JavaObject, name: str) -> bool:
    return is_instance_of(spark.sparkContext._gateway, thing, name)


def _nodes(spark: SparkSession, plan: JavaObject) -> Iterator[JavaObject]:
    """Every node and expression of an analysed plan, subqueries and common table expressions too."""
    pending = [plan]
    while pending:
        node = pending.pop()
        yield node
        pending += _elements(node.children())
        expressions = list(_elements(node.expressions()))
        while expressions:
            part = expressions.pop()
            yield part
            if _instance(spark, part, SUBQUERY):
                pending.append(part.plan())
            expressions += _elements(part.children())


def _relation(spark: SparkSession, node: JavaObject) -> str | None:
    """The full name of a table, or the path of files, that a leaf of a plan reads."""
    kind = node.getClass().getSimpleName()
    if kind == "LogicalRelation":
        table = node.catalogTable()
        if table.isDefined():
            return table.get().identifier().unquotedString()
        relation = node.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            return ",".join(str(path.toString()) for path in _elements(relation.location().rootPaths()))
        return relation.getClass().getName()
    if kind == "DataSourceV2Relation":
        return ".".join([*([node.catalog().get().name()] if node.catalog().isDefined() else []), node.table().name()])
    if kind == "HiveTableRelation":
        return node.tableMeta().identifier().unquotedString()
    return None


def relations_read(df: DataFrame) -> list[str]:
    """Tables, and paths that were read without a name, that a query reads at any depth."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    return sorted({name for node in _nodes(spark, plan) if (name := _relation(spark, node)) is not None})


def read_only(spark: SparkSession, statement: str) -> DataFrame:
    """The result of a query; anything else is refused before it could do a thing.

    A statement that changes data, tables or settings is not a query, so it cannot be a
    common table expression: Spark's own parser refuses it there. What passes is analysed
    there, not run, and every node of that plan is looked at.
    """
    try:
        inner = spark.sql(f"WITH asked AS (\n{statement}\n) SELECT * FROM asked")
    except ParseException as error:
        raise NotReadOnly(f"only queries are allowed here: {error.getMessage()}") from error
    for node in _nodes(spark, inner._jdf.queryExecution().analyzed()):
        if any(_instance(spark, node, name) for name in REFUSED):
            raise NotReadOnly(f"a query cannot hold {node.getClass().getSimpleName()}")
    return spark.sql(statement)


def folder_session(spark: SparkSession, folder: str, tables: Iterable[str]) -> SparkSession:
    """A session in which the tables of a folder have their own names; views of the caller's stay as they are."""
    own = own_session(spark)
    for table in tables:
        scan(own, folder, table).createTempView(table)
    return own


def requests_of(df: DataFrame, kind: str, principal: object, names: dict[str, str] | None = None) -> DataFrame:
    """What a query asks to read, as rows for ``check_access``: one for each relation.

    ``names`` gives the path in the access declarations of a relation's name; a relation
    that it lacks is asked for by its own name.
    """
    found = relations_read(df)
    rows = [(i, kind, principal, (names or {}).get(name, name), "read") for i, name in enumerate(found)]
    types = {int: "bigint", str: "string"}[type(principal)]
    schema = f"request_id bigint, kind string, principal {types}, table_path string, action string"
    return df.sparkSession.createDataFrame(rows, schema)


def authorised(
    spark: SparkSession,
    statement: str,
    kind: str,
    principal: object,
    grants: DataFrame,
    members: DataFrame,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """The result of a query that reads only what the principal may read.

    Each relation at any depth, in a common table expression or a subquery too, has to be
    ``allowed`` by ``check_access``; otherwise the query fails before it reads a row.
    """
    df = read_only(spark, statement)
    outcome = check_access(requests_of(df, kind, principal, names), grants, members)
    refused = outcome.filter(F.col("outcome") != "allowed").select("table_path", "outcome").collect()
    if refused:
        listed = ", ".join(f"{r['table_path']} ({r['outcome']})" for r in sorted(refused))
        raise PermissionError(f"{principal} may not read {listed}")
    return df
