"""Table contracts: a declared schema that DataFrames are held against."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from tablewright.functions.columns import assignable, checked, converted, fits

REFUSED_REASON, REFUSED_ROW, BROKEN = "refused_reason", "refused_row", "_broken"


@dataclass(frozen=True)
class TableContract:
    """Name, columns and storage rules of one table.

    ``days`` names the timestamp column whose day the table is partitioned by.
    """

    name: str
    schema: StructType
    comment: str = ""
    properties: Mapping[str, object] = field(default_factory=dict)
    days: str | None = None

    @property
    def day_column(self) -> str:
        if self.days is None:
            raise ValueError(f"{self.name} is not partitioned by day")
        return self.days.removesuffix("_ts") + "_day"


# The declared tables and the rows that seed the first of them.
SALES_ORDERS = TableContract(
    name="sales.orders",
    schema=StructType(
        [
            StructField("order_id", LongType()),
            StructField("customer", StringType()),
            StructField("amount", DoubleType()),
        ]
    ),
)
TRANSLATED_DOCUMENTS = TableContract(
    name="content.translated_documents_sensitive",
    schema=StructType(
        [
            StructField("document_id", LongType()),
            StructField("source_language", StringType()),
            StructField("translated_text", StringType()),
        ]
    ),
)
SALES_ORDERS_V2 = TableContract(
    name="sales.orders_v2",
    comment="Canonical sales order line items (successor to sales.orders)",
    schema=StructType(
        [
            StructField("order_id", LongType(), False, {"comment": "Primary key"}),
            StructField("customer", StringType(), False),
            StructField("amount", DecimalType(10, 2), False),
            StructField("order_ts", TimestampType(), False, {"comment": "Order placement time, UTC"}),
        ]
    ),
    properties={"write.format.default": "parquet"},
    days="order_ts",
)
SALES_ORDERS_V3 = TableContract(
    name="sales.orders_v3",
    comment="Sales order line items, partitioned by day",
    schema=StructType(
        [
            StructField("order_id", LongType(), False, {"comment": "Primary key"}),
            StructField("amount", DoubleType(), False),
            StructField("order_ts", TimestampType(), False, {"comment": "Order placement time, UTC"}),
        ]
    ),
    properties={"write.format.default": "parquet"},
    days="order_ts",
)
CONTRACTS = [SALES_ORDERS, TRANSLATED_DOCUMENTS, SALES_ORDERS_V2, SALES_ORDERS_V3]
NAMESPACES = ["sales", "sales_reporting", "content"]
SALES_ORDERS_SEED = [
    (1, "acme-corp", 1250.00),
    (2, "globex-inc", 430.50),
    (3, "initech", 89.99),
    (4, "umbrella-corp", 2100.75),
    (5, "stark-industries", 560.20),
]


def empty(spark: SparkSession, contract: TableContract) -> DataFrame:
    return spark.createDataFrame([], contract.schema)


def describe(spark: SparkSession, contract: TableContract) -> DataFrame:
    """The contract's columns as rows."""
    rows = [
        (f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
        for f in contract.schema
    ]
    return spark.createDataFrame(
        rows, "column_name string, data_type string, nullable boolean, comment string"
    )


def differences(schema: StructType, contract: TableContract, strict: bool = True) -> list[str]:
    """What keeps ``schema`` from being the contract's; empty when nothing does.

    Stored Parquet forgets which columns are required, so tables that were read
    back are compared with ``strict=False``: names, types and order only.
    """
    found = {f.name: f for f in schema}
    wanted = {f.name: f for f in contract.schema}
    notes = [f"missing column {name}" for name in wanted if name not in found]
    notes += [f"unknown column {name}" for name in found if name not in wanted]
    for name in wanted.keys() & found.keys():
        have, want = found[name], wanted[name]
        if have.dataType != want.dataType:
            notes.append(f"{name}: {have.dataType.simpleString()} instead of {want.dataType.simpleString()}")
        if strict and have.nullable != want.nullable:
            notes.append(f"{name}: nullable is {have.nullable}")
        if strict and have.metadata != want.metadata:
            notes.append(f"{name}: metadata differs")
    if not notes and schema.fieldNames() != contract.schema.fieldNames():
        notes.append("column order differs")
    return sorted(notes)


def matches(df: DataFrame, contract: TableContract, strict: bool = True) -> bool:
    return not differences(df.schema, contract, strict)


def _require_columns(df: DataFrame, contract: TableContract) -> None:
    wanted, found = set(contract.schema.fieldNames()), set(df.columns)
    if wanted != found or len(df.columns) != len(found):
        raise ValueError(
            f"{contract.name}: missing {sorted(wanted - found)}, unknown {sorted(found - wanted)}"
        )
    unlike = [
        f"{f.name}: {df.schema[f.name].dataType.simpleString()} into {f.dataType.simpleString()}"
        for f in contract.schema
        if not assignable(df.schema[f.name].dataType, f.dataType)
    ]
    if unlike:
        raise TypeError(f"{contract.name}: {', '.join(unlike)}")


def _require_zone(df: DataFrame, contract: TableContract) -> None:
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    for f in contract.schema:
        local = isinstance(df.schema[f.name].dataType, TimestampNTZType)
        if local and isinstance(f.dataType, TimestampType) and zone not in ("UTC", "Etc/UTC"):
            raise ValueError(f"{contract.name}.{f.name} is UTC, but the session time zone is {zone}")


def violations(df: DataFrame, contract: TableContract) -> DataFrame:
    """Per column, the rows that may not be stored; one pass over ``df``.

    ``null_rows`` counts NULLs in required columns, ``unfit_rows`` values that the
    column's type cannot hold, among them fractions for an integer. Types that do
    not go into each other at all are refused as in :func:`conform`.
    """
    _require_columns(df, contract)
    counts = []
    for f in contract.schema:
        value = F.col(f.name)
        nulls = F.lit(0).cast("long") if f.nullable else F.count_if(value.isNull())
        counts.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                nulls.alias("null_rows"),
                F.count_if(~fits(value, df.schema[f.name].dataType, f.dataType)).alias("unfit_rows"),
            )
        )
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def conform(df: DataFrame, contract: TableContract) -> DataFrame:
    """``df`` in the contract's column order and types, checked as it is read.

    A row the contract forbids fails the job that reads the offending column, so
    a write, which reads all of them, commits all of its rows or none. Columns
    are matched by name. Types that a by-name append would not take are refused
    before any job. A number must fit an integer exactly; a decimal column rounds
    to its scale. The result matches the contract strictly.
    """
    _require_columns(df, contract)
    _require_zone(df, contract)
    types = {f.name: f.dataType for f in df.schema}
    return df.select(
        *[
            checked(F.col(f.name), types[f.name], f.dataType, f.nullable, f"{contract.name}.{f.name}").alias(
                f.name, metadata=f.metadata
            )
            for f in contract.schema
        ]
    )


def _rules(contract: TableContract) -> list[tuple[str, str, str]]:
    """Column, kind of breach and its text, in the contract's order."""
    kinds = [("null_rows", "missing"), ("unfit_rows", "unfit")]
    return [(f.name, kind, f"{f.name}: {word}") for f in contract.schema for kind, word in kinds if not (f.nullable and kind == "null_rows")]


def judged(df: DataFrame, contract: TableContract) -> DataFrame:
    """Every row with the rules it breaks, for a write that takes all of them in one pass.

    A row that keeps all rules has the contract's columns, as :func:`conform` makes them,
    and NULL in ``refused_reason`` and ``refused_row``. Any other has NULL in the contract's
    columns, the first rule that it breaks, and itself as JSON. ``_broken`` lists all the
    rules that a row breaks. Columns and types are matched as in :func:`conform`.
    """
    _require_columns(df, contract)
    _require_zone(df, contract)
    breaches: dict[tuple[str, str], Column] = {}
    for f in contract.schema:
        value = F.col(f"`{f.name}`")
        breaches[f.name, "null_rows"] = value.isNull()
        breaches[f.name, "unfit_rows"] = ~fits(value, df.schema[f.name].dataType, f.dataType)
    found = [F.when(breaches[name, kind], F.lit(text)) for name, kind, text in _rules(contract)]
    marked = df.withColumn(BROKEN, F.array_compact(F.array(*found)))
    whole = F.size(BROKEN) == 0
    values = [
        F.when(whole, converted(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType)).alias(f.name, metadata=f.metadata)
        for f in contract.schema
    ]
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return marked.select(
        *values, F.when(~whole, row).alias(REFUSED_ROW), F.try_element_at(BROKEN, F.lit(1)).alias(REFUSED_REASON), BROKEN
    )


def observed(rows: DataFrame, contract: TableContract, into: Observation) -> DataFrame:
    """The rows of :func:`judged`, counted by rule as they pass."""
    counts = [F.count_if(F.array_contains(BROKEN, text)).alias(text) for _, _, text in _rules(contract)]
    return rows.observe(into, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(BROKEN) > 0).alias("refused"), *counts)


def observed_violations(spark: SparkSession, contract: TableContract, seen: Mapping[str, int]) -> DataFrame:
    """What :func:`observed` counted, in the shape of :func:`violations`."""
    counts = {(name, kind): seen[text] for name, kind, text in _rules(contract)}
    names = contract.schema.fieldNames()
    rows: Sequence[tuple] = [(n, counts.get((n, "null_rows"), 0), counts[n, "unfit_rows"]) for n in names]
    return spark.createDataFrame(rows, "column_name string, null_rows bigint, unfit_rows bigint")
