"""One function per registered query: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from tablewright.functions.columns import (
    ancestor_paths,
    day_of,
    leaf_name,
    options_map,
    parent_path,
)
from tablewright.operators import access, contracts, maintenance, relational
from tablewright.plans.inputs import (
    TABLES,
    WAREHOUSE,
    customer_groups,
    group_declarations,
    misplaced_grants,
    nation_grants,
    nation_tables,
    sales_orders,
)
from tablewright.sources import catalog
from tablewright.sources.guarded import authorised, folder_session, read_only, relations_read
from tablewright.sources.parquet import scan
from tablewright.sources.scratch import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The order table without its time column, and line items with a zone-less one:
# the test tables hold TIMESTAMP_NTZ, whose cast depends on the session.
ORDER_LINES = replace(
    contracts.SALES_ORDERS_V2,
    name="sales.order_lines",
    schema=StructType([f for f in contracts.SALES_ORDERS_V2.schema if f.name != "order_ts"]),
    days=None,
)
DAILY_LINES = replace(
    contracts.SALES_ORDERS_V3,
    name="sales.daily_lines",
    schema=StructType(
        [
            StructField(f.name, TimestampNTZType(), f.nullable, f.metadata) if f.name == "order_ts" else f
            for f in contracts.SALES_ORDERS_V3.schema
        ]
    ),
)


def registered(query: Query) -> Query:
    QUERIES[f"q_{query.__name__}"] = query
    return query


def _new_namespace(spark: SparkSession) -> str:
    """A namespace of the query's own, stored below the scratch folder."""
    name = f"run_{uuid4().hex}"
    catalog.ensure_namespace(spark, name, scratch_folder(spark, "tables"))
    return name


def _batches(df: DataFrame, column: str, values: list[str]) -> list[DataFrame]:
    """All rows of ``df``: those of each value, then the rest."""
    named = F.coalesce(F.col(column).isin(values), F.lit(False))
    return [*[df.filter(F.col(column) == value) for value in values], df.filter(~named)]


def _line_items(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("order_ts"),
    )


# -- scans and projection -----------------------------------------------------


@registered
def scan_orders(spark: SparkSession, folder: str) -> DataFrame:
    return sales_orders(spark, folder)


@registered
def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    return relational.project(
        scan(spark, folder, "documents"),
        ["doc_id", "lang", "text"],
        {"doc_id": "document_id", "lang": "source_language", "text": "translated_text"},
    )


@registered
def select_all(spark: SparkSession, folder: str) -> DataFrame:
    return read_only(folder_session(spark, folder, ["conversations"]), "SELECT * FROM conversations")


@registered
def project_rename(spark: SparkSession, folder: str) -> DataFrame:
    orders = relational.doubled(sales_orders(spark, folder), "amount", "double_amount")
    return relational.project(orders, ["order_id", "customer", "double_amount"], {"double_amount": "amount"})


@registered
def native_double(spark: SparkSession, folder: str) -> DataFrame:
    orders = relational.project(
        scan(spark, folder, "orders"),
        ["o_orderkey", "o_totalprice"],
        {"o_orderkey": "order_id", "o_totalprice": "amount"},
    )
    return relational.doubled(orders, "amount", "double_amount")


@registered
def map_cents(spark: SparkSession, folder: str) -> DataFrame:
    """Order prices in cents, worked out on Arrow columns one batch at a time."""

    def in_cents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (
            pd.DataFrame({"order_id": b["o_orderkey"], "cents": (b["o_totalprice"] * 100).round().astype("int64")})
            for b in batches
        )

    orders = scan(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return relational.map_batches(orders, in_cents, "order_id long, cents long")


@registered
def stamped_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Load time and order day of every order, as days."""
    orders = relational.stamped(scan(spark, folder, "orders"), "loaded_at", datetime(2024, 1, 1, 12))
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        day_of("o_orderdate").alias("order_day"),
        day_of("loaded_at").alias("loaded_on"),
    )


@registered
def map_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A map built per row and read by key; a key it lacks gives NULL."""
    facts = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    orders = scan(spark, folder, "orders").select("o_orderkey", facts.alias("facts"), options_map(source="orders").alias("options"))
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("facts")["status"].alias("status"),
        F.col("facts")["owner"].alias("owner"),
        F.col("options")["source"].alias("source"),
    )


@registered
def resource_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every level above (and including) each customer's table, with the tables it covers."""
    nations = nation_tables(spark, folder).select(F.col("n_nationkey").alias("c_nationkey"), "table_path")
    customers = scan(spark, folder, "customer").select("c_custkey", "c_nationkey")
    tables = relational.look_up(customers, nations, "c_nationkey").select(
        F.concat_ws(".", "table_path", "c_custkey").alias("path")
    )
    levels = tables.select(F.explode(ancestor_paths("path")).alias("resource_path"))
    counted = relational.sum_by(levels.withColumn("one", F.lit(1)), "resource_path", "one", "tables_covered")
    return counted.select(
        "resource_path",
        parent_path("resource_path").alias("parent_path"),
        leaf_name("resource_path").alias("name"),
        "tables_covered",
    )


# -- joins, sums, order -------------------------------------------------------


@registered
def anti_amount(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose amount no processed order has."""
    orders = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), "o_orderstatus"
    )
    processed = orders.filter(F.col("o_orderstatus") == "F")
    return relational.anti_join(orders.drop("o_orderstatus"), processed, "amount")


@registered
def totals(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    lines = scan(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"), price.alias("amount"))
    return relational.sum_by(lines, "order_id", "amount", "total_amount")


@registered
def totals_double(spark: SparkSession, folder: str) -> DataFrame:
    return folder_session(spark, folder, ["lineitem"]).sql(
        "SELECT l_orderkey AS order_id, ROUND(SUM(l_extendedprice), 2) AS total_amount "
        "FROM lineitem GROUP BY l_orderkey"
    )


@registered
def exact_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The same total as a double, rounded once: whatever order the rows come in."""
    lines = scan(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_extendedprice")
    return relational.exact_sum_by(lines, "order_id", "l_extendedprice", "total_amount")


@registered
def exact_total(spark: SparkSession, folder: str) -> DataFrame:
    """Per status of the lines, discounted prices with all their bits: few keys that hold all rows."""
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = scan(spark, folder, "lineitem").select("l_linestatus", paid.alias("paid"))
    return relational.exact_sum_by(lines, "l_linestatus", "paid", "total_paid")


@registered
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return relational.row_count(scan(spark, folder, "lineitem"))


@registered
def total_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount")
    )
    return relational.total_order(orders, "order_id")


@registered
def top_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount")
    )
    return relational.first_rows(orders, 2, "order_id")


# -- contracts and catalog tables ---------------------------------------------


@registered
def contract_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's columns, each with the rows of the order lines that fill it."""
    lines = contracts.conform(sales_orders(spark, folder), ORDER_LINES)
    filled = lines.agg(
        F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("filled_rows")) for c in lines.columns]
        ).alias("counts")
    ).select(F.inline("counts"))
    return contracts.describe(spark, ORDER_LINES).join(filled, "column_name")


@registered
def violations(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that the contract forbids.

    Orders without line items have no amount and no time; a number made of order and
    discount has a fraction, which the order's number cannot hold.
    """
    return contracts.violations(_candidate_lines(spark, folder), DAILY_LINES)


def _candidate_lines(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_discount", "l_extendedprice", "l_shipdate")
    return orders.join(lines, "l_orderkey", "left").select(
        (F.col("l_orderkey") + F.coalesce("l_discount", F.lit(0.0))).alias("order_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("order_ts"),
    )


def _with_day(lines: DataFrame) -> DataFrame:
    return lines.withColumn("order_day", day_of("order_ts")).drop("order_ts")


def _judged_lines(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The candidate lines appended to a table that keeps what it refuses, and the counts of that write."""
    name = f"{_new_namespace(spark)}.daily_lines"
    catalog.apply_contract(spark, DAILY_LINES, name, keep_refused=True)
    return name, catalog.append_judged(_candidate_lines(spark, folder), name, DAILY_LINES)


@registered
def write_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The breaches of each rule, counted while kept and refused lines are written."""
    return _judged_lines(spark, folder)[1]


@registered
def kept_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What the table of that write holds: the lines that keep every rule."""
    name, _ = _judged_lines(spark, folder)
    return _with_day(catalog.read_contract(spark, DAILY_LINES, name))


@registered
def refused_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What it refused, with the first rule that each line breaks."""
    name, _ = _judged_lines(spark, folder)
    row = F.from_json("refused_row", "order_id double, amount double, order_ts timestamp_ntz")
    return _with_day(catalog.read_refused(spark, name).select("refused_reason", row.alias("row")).select("refused_reason", "row.*"))


@registered
def namespaces(spark: SparkSession, folder: str) -> DataFrame:
    """Contract tables of a new namespace: listed, present, created once, filled."""
    space = _new_namespace(spark)
    name = f"{space}.order_lines"
    first = catalog.apply_contract(spark, ORDER_LINES, name)
    again = catalog.apply_contract(spark, ORDER_LINES, name)
    catalog.append_rows(sales_orders(spark, folder), name, ORDER_LINES)
    table = catalog.read_table(spark, name)
    listed = not catalog.list_namespaces(spark).filter(F.col("namespace") == space).isEmpty()
    return relational.row_count(table).select(
        F.lit(listed).alias("namespace_listed"),
        F.lit(first).alias("created_first"),
        F.lit(again).alias("created_again"),
        F.lit(catalog.table_exists(spark, name)).alias("table_exists"),
        F.lit(contracts.matches(table, ORDER_LINES, strict=False)).alias("shape_matches"),
        "row_count",
    )


@registered
def append_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """One append per order status, the columns of each in another order."""
    name = f"{_new_namespace(spark)}.order_lines"
    catalog.apply_contract(spark, ORDER_LINES, name)
    orders = sales_orders(spark, folder, "o_orderstatus")
    columns = ["order_id", "customer", "amount"]
    for batch in _batches(orders, "o_orderstatus", ["F", "O"]):
        catalog.append_rows(batch.select(columns), name, ORDER_LINES)
        columns = columns[1:] + columns[:1]
    return catalog.read_table(spark, name)


@registered
def create_from_query(spark: SparkSession, folder: str) -> DataFrame:
    name = f"{_new_namespace(spark)}.doubled"
    catalog.create_from(native_double(spark, folder), name)
    return catalog.read_table(spark, name)


@registered
def seed_if_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Seeding twice leaves one copy."""
    name = f"{_new_namespace(spark)}.orders"
    catalog.apply_contract(spark, contracts.SALES_ORDERS, name)
    seed = sales_orders(spark, folder)
    catalog.seed_if_empty(seed, name)
    catalog.seed_if_empty(seed, name)
    return catalog.read_table(spark, name)


@registered
def day_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """All line items stored by day, January 1996 read back."""
    name = f"{_new_namespace(spark)}.daily_lines"
    catalog.apply_contract(spark, DAILY_LINES, name)
    catalog.append_rows(_line_items(spark, folder), name, DAILY_LINES)
    month = catalog.read_days(spark, DAILY_LINES, "1996-01-01", "1996-01-31", name)
    return month.groupBy(day_of("order_ts").alias("order_day")).agg(F.count(F.lit(1)).alias("row_count"))


@registered
def listed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of the days on which more than one urgent order came in."""
    name = f"{_new_namespace(spark)}.daily_lines"
    catalog.apply_contract(spark, DAILY_LINES, name)
    catalog.append_rows(_line_items(spark, folder), name, DAILY_LINES)
    urgent = scan(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    busy = urgent.groupBy(day_of("o_orderdate").alias("order_day")).agg(F.count(F.lit(1)).alias("orders"))
    days = busy.filter(F.col("orders") > 1)
    return _with_day(catalog.read_listed_days(spark, DAILY_LINES, days, "order_day", name))


# -- ad-hoc SQL ---------------------------------------------------------------

ADHOC = """
    WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders))
    SELECT c_mktsegment AS segment, COUNT(*) AS big_orders
    FROM customer JOIN big ON c_custkey = o_custkey
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    GROUP BY c_mktsegment
"""


def _paths(folder: str, tables: list[str]) -> dict[str, str]:
    """The tables of a folder as paths of the access declarations, by the names that Spark reads them under."""
    return {f"{folder.rstrip('/')}/{t}.parquet": f"{WAREHOUSE}.sales.{t}" for t in tables}


@registered
def adhoc_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The tables that a query reads, in a common table expression and in subqueries too, with their rows."""
    tables = ["customer", "lineitem", "nation", "orders"]
    own = folder_session(spark, folder, tables)
    read = [path.rsplit("/", 1)[-1].removesuffix(".parquet") for path in relations_read(read_only(own, ADHOC))]
    counts = [relational.row_count(scan(spark, folder, t)).select(F.lit(t).alias("table_name"), "row_count") for t in read]
    return reduce(DataFrame.unionAll, counts)


@registered
def adhoc_authorised(spark: SparkSession, folder: str) -> DataFrame:
    """A query by a member of the nation whose group may modify the whole namespace."""
    tables = ["customer", "lineitem", "orders"]
    own = folder_session(spark, folder, tables)
    names = {f"file:{path}" if path.startswith("/") else path: name for path, name in _paths(folder, tables).items()}
    grants = scan(own, folder, "nation").select(
        F.col("n_name").alias("group_name"),
        F.lit("namespace").alias("resource_type"),
        F.lit(f"{WAREHOUSE}.sales").alias("resource_path"),
        F.lit("modify").alias("permission"),
    )
    return authorised(own, ADHOC, "email", 1, grants, customer_groups(own, folder), names)


# -- files, compaction, history -----------------------------------------------


@registered
def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table by its data files, and whether all files have a size."""

    paths = {table: f"{folder.rstrip('/')}/{table}.parquet" for table in TABLES}
    scans = [scan(spark, folder, table).select("_metadata") for table in TABLES]
    listings = [maintenance.file_listing(spark, path).withColumn("table_name", F.lit(table)) for table, path in paths.items()]
    files = maintenance.file_inventory(
        reduce(DataFrame.unionAll, scans), "table_name", listing=reduce(DataFrame.unionAll, listings)
    )
    return files.groupBy("table_name").agg(
        F.min(F.col("file_size_in_bytes") > 0).alias("all_sized"), F.sum("record_count").alias("record_count")
    )


@registered
def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files by their rows: line items written by line number, of which there is no 0, so one file is empty."""
    path = scratch_folder(spark, "lines")
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    lines.repartitionById(8, F.col("l_linenumber")).write.parquet(path)
    files = maintenance.file_inventory(spark.read.schema(lines.schema).parquet(path), listing=maintenance.file_listing(spark, path))
    return files.groupBy("record_count").agg(F.count(F.lit(1)).alias("files"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]  # and the rest
BATCHES = len(PRIORITIES) + 1


def _orders_in_batches(spark: SparkSession, folder: str, partition_by: list[str]) -> str:
    """Orders published one priority at a time; returns the table's root."""
    root = scratch_folder(spark, "orders")
    orders = scan(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    for batch in _batches(orders, "o_orderpriority", PRIORITIES):
        maintenance.publish(batch, root, partition_by)
    return root


@registered
def compact_rows(spark: SparkSession, folder: str) -> DataFrame:
    root = _orders_in_batches(spark, folder, [])
    maintenance.compact(spark, root)
    return maintenance.read_state(spark, root)


@registered
def compact_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What a compaction changed: there are fewer files, and the rows are the same."""
    root = _orders_in_batches(spark, folder, [])
    result = maintenance.compact(spark, root)
    before = maintenance.read_state(spark, root, BATCHES)
    after = maintenance.read_state(spark, root)
    changed = maintenance.table_differences(before, after)
    fewer = F.col("rewritten_data_files_count") > F.col("added_data_files_count")
    numbers = [
        result.select(F.lit("fewer files"), fewer.cast("long")),
        relational.row_count(after).select(F.lit("rows"), "row_count"),
        relational.row_count(changed).select(F.lit("changed rows"), "row_count"),
    ]
    return reduce(DataFrame.unionAll, numbers).toDF("measure", "value")


@registered
def compact_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per partition before and after, and whether its files became fewer."""
    root = _orders_in_batches(spark, folder, ["o_orderstatus"])
    maintenance.compact(spark, root)

    def per_status(run_id: int | None, prefix: str) -> DataFrame:
        return maintenance.state_files(spark, root, run_id).groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias(f"{prefix}_files"), F.sum("record_count").alias(f"{prefix}_rows")
        )

    both = per_status(BATCHES, "before").join(per_status(None, "after"), "o_orderstatus")
    fewer = (F.col("after_files") < F.col("before_files")).alias("fewer_files")
    return both.select("o_orderstatus", "before_rows", "after_rows", fewer)


@registered
def compact_proof(spark: SparkSession, folder: str) -> DataFrame:
    """Per partition, whether a compaction left the sums of two row hashes as they were."""
    root = _orders_in_batches(spark, folder, ["o_orderstatus"])
    maintenance.compact(spark, root)
    before, after = (
        maintenance.fingerprint(maintenance.read_state(spark, root, run), "o_orderstatus") for run in (BATCHES, None)
    )
    same = (before["rows"] == after["rows"]) & (before["sum_a"] == after["sum_a"]) & (before["sum_b"] == after["sum_b"])
    return before.join(after, before["o_orderstatus"].eqNullSafe(after["o_orderstatus"])).select(
        before["o_orderstatus"], before["rows"].alias("row_count"), same.alias("unchanged")
    )


@registered
def changed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the orders when pending ones cost more and urgent finished ones went: found by fingerprints."""
    before = scan(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    after = before.filter(~gone).withColumn("o_totalprice", price)
    return maintenance.table_differences(before, after, "o_orderstatus")


@registered
def history(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of a table with its rows after each, and whether a run left it more files."""
    root = _orders_in_batches(spark, folder, [])
    maintenance.compact(spark, root)
    count = lambda name: F.col("summary")[name].cast("long")
    return maintenance.history(spark, root).select(
        "run_id",
        "operation",
        (count("added-data-files") > count("deleted-data-files")).alias("more_files"),
        count("total-records").alias("total_records"),
    )


@registered
def earlier_state(spark: SparkSession, folder: str) -> DataFrame:
    """The table as of its second commit, read after a compaction."""
    root = _orders_in_batches(spark, folder, ["o_orderstatus"])
    maintenance.compact(spark, root)
    return maintenance.read_state(spark, root, 2).select("o_orderkey", "o_orderstatus", "o_orderpriority")


# -- access -------------------------------------------------------------------


@registered
def memberships(spark: SparkSession, folder: str) -> DataFrame:
    return access.memberships(group_declarations(spark, folder))


def _declared(spark: SparkSession, folder: str) -> DataFrame:
    """A document per customer, which declares its nation's group and, per nation's region, a grant to it."""
    nations = nation_tables(spark, folder)
    customers = scan(spark, folder, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    group = F.struct(
        F.lit("Customers of one nation").alias("description"),
        F.when(F.col("c_acctbal") >= 0, F.array("c_name")).alias("members"),
        F.when(F.col("c_acctbal") < 0, F.array("c_name")).alias("service_accounts"),
    )
    grant = F.struct(
        F.col("n_name").alias("group"),
        F.when(F.col("c_mktsegment") == "BUILDING", "warehouse").otherwise("namespace").alias("resource_type"),
        F.col("namespace").alias("resource_path"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "write").otherwise("select").alias("permission"),
    )
    documents = relational.look_up(customers, nations, "n_nationkey")
    return documents.select(F.create_map("n_name", group).alias("groups"), F.array(grant).alias("grants"))


@registered
def declared_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """The members of nested declarations, one document per customer."""
    return access.memberships(access.declared_groups(_declared(spark, folder)))


@registered
def reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """All steps from a state that holds the groups and grants of one region and no members elsewhere."""
    spec = _declared(spark, folder)
    groups, grants = access.declared_groups(spec), access.declared_grants(spec)
    asia = nation_tables(spark, folder).filter(F.col("r_name") == "ASIA").select(F.col("n_name").alias("group_name"), "namespace")
    members = access.memberships(groups).join(asia, "group_name", "left_semi")
    held = asia.select(
        "group_name",
        F.lit("namespace").alias("resource_type"),
        F.col("namespace").alias("resource_path"),
        F.lit("select").alias("permission"),
    )
    return access.reconciliation(groups, grants, asia.select("group_name"), members, held)


@registered
def resolved_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Members with the id of their role and their own."""
    nation = scan(spark, folder, "nation")
    roles = nation.select(F.col("n_name").alias("group_name"), F.col("n_nationkey").alias("role_id"))
    identities = scan(spark, folder, "customer").select(
        F.lit("email").alias("kind"), F.col("c_custkey").alias("principal"), F.col("c_name").alias("subject_id")
    )
    return access.resolved_memberships(customer_groups(spark, folder), roles, identities)


@registered
def unresolved_members(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, as members of their status, that no line item knows."""
    members = scan(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("group_name"), F.col("o_orderkey").alias("principal")
    )
    known = scan(spark, folder, "lineitem").select(F.col("l_orderkey").alias("principal"))
    return access.unresolved(members, known, "principal")


@registered
def rejected_grants(spark: SparkSession, folder: str) -> DataFrame:
    """A grant per order; groups of one region are not declared, one permission and one type are unknown.

    Every path has two steps, which is too few for the grants on tables.
    """
    members = customer_groups(spark, folder).withColumnRenamed("principal", "o_custkey")
    grants = relational.look_up(scan(spark, folder, "orders"), members, "o_custkey").select(
        F.col("o_orderkey").alias("grant_id"),
        "group_name",
        F.when(F.col("o_orderstatus") == "F", "table")
        .when(F.col("o_orderstatus") == "O", "namespace")
        .otherwise("view")
        .alias("resource_type"),
        F.concat_ws(".", F.lit(WAREHOUSE), "group_name").alias("resource_path"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "modify")
        .when(F.col("o_orderpriority") == "2-HIGH", "write")
        .otherwise("select")
        .alias("permission"),
    )
    declared = nation_tables(spark, folder).filter(F.col("r_name") != "AFRICA").select(F.col("n_name").alias("name"))
    return access.rejected_grants(grants, declared)


@registered
def missing_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Customers join their nation's group; those with a finished order already have."""
    members = customer_groups(spark, folder)
    finished = scan(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("principal"))
    held = members.join(finished, "principal", "left_semi")
    return access.missing_memberships(members, held.select(*members.columns))


@registered
def missing_grants(spark: SparkSession, folder: str) -> DataFrame:
    """A supplier reads each part it ships; grants exist where a line is finished."""
    lines = scan(spark, folder, "lineitem")
    wanted = [
        F.concat_ws("-", F.lit("supplier"), "l_suppkey").alias("group_name"),
        F.lit("table").alias("resource_type"),
        F.concat_ws(".", F.lit(WAREHOUSE), F.lit("parts"), "l_partkey").alias("resource_path"),
        F.lit("select").alias("permission"),
    ]
    existing = lines.filter(F.col("l_linestatus") == "F")
    return access.missing_grants(lines.select(*wanted), existing.select(*wanted))


@registered
def effective_access(spark: SparkSession, folder: str) -> DataFrame:
    """Grants by nation; those on a region as if it were a table, and service accounts, give nothing more."""
    listed = access.effective_access(
        nation_tables(spark, folder).select("table_path"),
        nation_grants(spark, folder).unionByName(misplaced_grants(spark, folder)),
        customer_groups(spark, folder),
    )
    return listed.select(
        F.col("principal").alias("user_id"), leaf_name("table_path").alias("table_name"), "permission"
    )


@registered
def grant_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Principals per table and permission, those of q_effective_access, counted by bitmaps.

    Customers with a finished order are in a group for all of them too, and that group
    reads every table.
    """
    finished = scan(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    also = finished.select(F.lit("finished").alias("group_name"), F.lit("email").alias("kind"), F.col("o_custkey").alias("principal"))
    everywhere = spark.range(1).select(
        F.lit("finished").alias("group_name"),
        F.lit("warehouse").alias("resource_type"),
        F.lit(WAREHOUSE).alias("resource_path"),
        F.lit("select").alias("permission"),
    )
    members = customer_groups(spark, folder).unionByName(also)
    path = scratch_folder(spark, "numbers")
    access.numbered_members(members).write.parquet(path)
    reach = access.grant_reach(
        nation_tables(spark, folder).select("table_path"),
        nation_grants(spark, folder).unionByName(misplaced_grants(spark, folder)).unionByName(everywhere),
        access.member_bitmaps(spark.read.parquet(path)),
    )
    return reach.select(leaf_name("table_path").alias("table_name"), "permission", "principals")


@registered
def access_check(spark: SparkSession, folder: str) -> DataFrame:
    """Each order asks for one nation's table, its status says what for.

    The least urgent ask as service accounts, which share their names with people only.
    """
    tables = nation_tables(spark, folder).select("n_nationkey", "table_path")
    action = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "write").otherwise("compact")
    asked = scan(spark, folder, "orders").withColumn("n_nationkey", (F.col("o_orderkey") % 25).cast("int"))
    requests = relational.look_up(asked, tables, "n_nationkey").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "service_account").otherwise("email").alias("kind"),
        F.col("o_custkey").alias("principal"),
        "table_path",
        action.alias("action"),
    )
    grants = nation_grants(spark, folder).unionByName(misplaced_grants(spark, folder))
    return access.check_access(requests, grants, customer_groups(spark, folder))


@registered
def orphan_members(spark: SparkSession, folder: str) -> DataFrame:
    """Stored ids of every tenth customer have drifted from the live ones."""
    customers = scan(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    drifted = F.when(F.col("user_id") % 10 == 0, F.col("user_id") + 1_000_000).otherwise(F.col("user_id"))
    stored = customers.withColumn("subject_id", drifted)
    live = customers.select(F.col("user_id").alias("subject_id"))
    return access.orphans(stored, live).select("user_id")
