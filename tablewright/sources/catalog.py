"""Named tables: namespaces, contract tables, appends, day-partition reads.

The session catalog stores Parquet tables and cannot partition by an expression,
so a contract with ``days`` gets a stored ``order_day``-style column there
(:attr:`TableContract.day_column`), and properties that name it and its source.
Another configured catalog is reached by a three-part name (or by
:func:`use_catalog`) and gets the day transform itself; those branches could not
be run here, where only the built-in catalog was at hand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import day_literal, day_of
from tablewright.operators.contracts import (
    BROKEN,
    CONTRACTS,
    NAMESPACES,
    REFUSED_REASON,
    REFUSED_ROW,
    SALES_ORDERS,
    SALES_ORDERS_SEED,
    TableContract,
    conform,
    judged,
    observed,
    observed_violations,
)

SESSION_CATALOG = "spark_catalog"
DAY_COLUMN, DAY_SOURCE, REFUSALS = "tablewright.day.column", "tablewright.day.source", "tablewright.refusals"
SEEDS = {SALES_ORDERS.name: SALES_ORDERS_SEED}


def _quoted(name: str) -> str:
    return ".".join(f"`{part.strip('`')}`" for part in name.split("."))


def _text(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_session_catalog(spark: SparkSession, name: str) -> bool:
    parts = name.split(".")
    if parts[0] == SESSION_CATALOG:
        return True
    return len(parts) < 3 and spark.catalog.currentCatalog() == SESSION_CATALOG


def use_catalog(spark: SparkSession, catalog: str) -> None:
    spark.catalog.setCurrentCatalog(catalog)


def list_namespaces(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW NAMESPACES")


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    place = f" LOCATION {_text(location)}" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {_quoted(namespace)}{place}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_contract(spark: SparkSession, contract: TableContract, name: str | None = None) -> DataFrame:
    """The contract's columns and rows of its table, without a stored day column or refused rows."""
    return _declared(read_table(spark, name or contract.name), contract)


def _declared(rows: DataFrame, contract: TableContract) -> DataFrame:
    names = contract.schema.fieldNames()
    if REFUSED_REASON in rows.columns and REFUSED_REASON not in names:
        rows = rows.filter(F.col(REFUSED_REASON).isNull())
    return rows.select(*[_quoted(f) for f in names])


def read_refused(spark: SparkSession, name: str) -> DataFrame:
    """The rows that a table refused: ``refused_reason``, and ``refused_row`` as JSON."""
    return read_table(spark, name).filter(F.col(REFUSED_REASON).isNotNull()).select(REFUSED_REASON, REFUSED_ROW)


def apply_contracts(
    spark: SparkSession,
    contracts: Sequence[TableContract] = tuple(CONTRACTS),
    namespaces: Sequence[str] = tuple(NAMESPACES),
    seeds: Mapping[str, Sequence[tuple]] = SEEDS,
) -> DataFrame:
    """Namespaces, tables and the first rows of empty tables, in one call.

    One row per contract: ``table_name``, ``created``, ``seeded``. A second call
    changes nothing and returns false in both.
    """
    for namespace in namespaces:
        ensure_namespace(spark, namespace)
    done = []
    for contract in contracts:
        created = apply_contract(spark, contract)
        rows = seeds.get(contract.name)
        seeded = bool(rows) and seed_if_empty(
            spark.createDataFrame(rows, contract.schema), contract.name, contract
        )
        done.append((contract.name, created, seeded))
    return spark.createDataFrame(done, "table_name string, created boolean, seeded boolean")


def apply_contract(
    spark: SparkSession,
    contract: TableContract,
    name: str | None = None,
    provider: str | None = None,
    keep_refused: bool = False,
) -> bool:
    """Create the contract's table; an existing table is left as it is.

    Without a provider the built-in catalog stores Parquet and another one what it
    stores by default. ``keep_refused`` makes room for rows that :func:`append_judged`
    refuses: a partition of its own for each rule, which no read of the contract opens.
    The rules then hold for the rows without a reason, not for the stored columns.

    Returns whether a table was created.
    """
    name = name or contract.name
    ensure_namespace(spark, name.rsplit(".", 1)[0])
    if table_exists(spark, name):
        return False
    columns = [
        f"{_quoted(field.name)} {field.dataType.simpleString()}"
        + ("" if field.nullable or keep_refused else " NOT NULL")
        + (f" COMMENT {_text(field.metadata['comment'])}" if field.metadata.get("comment") else "")
        for field in contract.schema
    ]
    built_in, properties = in_session_catalog(spark, name), dict(contract.properties)
    provider = provider or ("parquet" if built_in else None)
    clauses = [f"USING {provider}"] if provider else []
    partitions = []
    if keep_refused:
        if clash := {REFUSED_REASON, REFUSED_ROW} & {*contract.schema.fieldNames()}:
            raise ValueError(f"{contract.name} has columns of its own named {sorted(clash)}")
        properties |= {REFUSALS: "stored"}
        columns += [f"{_quoted(REFUSED_ROW)} STRING", f"{_quoted(REFUSED_REASON)} STRING"]
        partitions.append(_quoted(REFUSED_REASON))
    if contract.days and built_in:
        properties |= {DAY_COLUMN: contract.day_column, DAY_SOURCE: contract.days}
        columns.append(f"{_quoted(contract.day_column)} DATE")
        partitions.append(_quoted(contract.day_column))
    elif contract.days:
        partitions.append(f"days({_quoted(contract.days)})")
    if partitions:
        clauses.append(f"PARTITIONED BY ({', '.join(partitions)})")
    if contract.comment:
        clauses.append(f"COMMENT {_text(contract.comment)}")
    if properties:
        listed = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items())
        clauses.append(f"TBLPROPERTIES ({listed})")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({', '.join(columns)}) {' '.join(clauses)}")
    return True


def append_rows(df: DataFrame, name: str, contract: TableContract | None = None) -> None:
    """Add rows to an existing table, columns matched by name.

    With a contract the rows are checked against it while they are written.
    Rows of a day-partitioned table are first gathered by day, which the table's
    own properties name; the rebalance splits a day that is large and joins days
    that are small.
    """
    if not table_exists(df.sparkSession, name):
        raise ValueError(f"table {name} does not exist")
    if contract is not None:
        df = conform(df, contract)
    noted = _properties(df.sparkSession, name)
    if REFUSALS in noted:
        df = df.withColumns({c: F.lit(None).cast("string") for c in (REFUSED_ROW, REFUSED_REASON)})
    rows, partitions = _placed(df, name, noted)
    _append(rows, name, partitions)


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()}


def _placed(df: DataFrame, name: str, noted: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Rows with their partition columns, gathered by them, and the names of those."""
    partitions = [REFUSED_REASON] if REFUSALS in noted else []
    if DAY_COLUMN in noted and in_session_catalog(df.sparkSession, name):
        df = df.withColumn(noted[DAY_COLUMN], day_of(_quoted(noted[DAY_SOURCE])))
        partitions.append(noted[DAY_COLUMN])
    return (df.hint("rebalance", *partitions) if partitions else df), partitions


def _append(rows: DataFrame, name: str, partitions: Sequence[str]) -> None:
    if not in_session_catalog(rows.sparkSession, name):
        rows.writeTo(name).append()
        return
    writer = rows.write.format("parquet").mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name)


def append_judged(df: DataFrame, name: str, contract: TableContract) -> DataFrame:
    """Add the rows that keep the contract, store the others beside them, and count: in one pass.

    ``df`` is read once. One write takes all rows, those that break a rule into the
    partition of that rule (:func:`read_refused`), so either all of them are stored or
    none. The counts are taken as the rows are written, after the last shuffle, where
    a task that runs again counts once. Returns them in the shape of ``violations``.
    The table has to be made with ``keep_refused``.
    """
    spark = df.sparkSession
    noted = _properties(spark, name)
    if REFUSALS not in noted:
        raise ValueError(f"table {name} keeps no refused rows")
    rows, partitions = _placed(judged(df, contract), name, noted)
    seen = Observation()
    _append(observed(rows, contract, seen).drop(BROKEN), name, partitions)
    return observed_violations(spark, contract, seen.get)


def create_from(df: DataFrame, name: str, provider: str = "parquet") -> None:
    """Create a table from a query; an existing table is an error."""
    df.writeTo(name).using(provider).create()


def seed_if_empty(df: DataFrame, name: str, contract: TableContract | None = None) -> bool:
    """Append only when the table holds no row; returns whether rows were added.

    The test stops at the first row it meets.
    """
    if not read_table(df.sparkSession, name).isEmpty():
        return False
    append_rows(df, name, contract)
    return True


def read_days(
    spark: SparkSession,
    contract: TableContract,
    first: date | str,
    last: date | str,
    name: str | None = None,
) -> DataFrame:
    """Rows of the days ``first`` to ``last``, both included.

    In the session catalog the condition goes to the stored day column, so other
    days are never opened; elsewhere the catalog derives that from the timestamp.
    """
    name = name or contract.name
    rows = read_table(spark, name)
    if in_session_catalog(spark, name):
        day = F.col(contract.day_column)
        return _declared(rows.filter(day.between(day_literal(first), day_literal(last))), contract)
    moment = F.col(contract.days)
    return rows.filter(
        (moment >= day_literal(first)) & (moment < F.date_add(day_literal(last), 1))
    )


def read_listed_days(
    spark: SparkSession, contract: TableContract, days: DataFrame, day: str, name: str | None = None
) -> DataFrame:
    """Rows of the days that another table names in its column ``day``.

    The days are joined, each once, to the stored day column, so Spark prunes partitions
    while the query runs and opens no file of another day. What is broadcast is a row per
    calendar day at most. NULL names no day; repeated days change nothing.
    """
    name = name or contract.name
    rows = read_table(spark, name)
    listed = days.select(F.col(day).cast("date").alias("_listed")).filter("_listed IS NOT NULL").distinct()
    if not in_session_catalog(spark, name):
        return rows.join(F.broadcast(listed), day_of(contract.days) == listed["_listed"], "left_semi")
    kept = rows.join(F.broadcast(listed), rows[contract.day_column] == listed["_listed"], "left_semi")
    return _declared(kept, contract)
