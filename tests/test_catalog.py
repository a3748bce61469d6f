import glob
from dataclasses import replace
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import contracts as c
from tablewright.sources import catalog


def orders(spark, rows):
    return spark.createDataFrame(rows, "order_id long, customer string, amount double, order_ts timestamp")


def test_contract_is_applied_once(spark, namespace):
    name = f"{namespace}.orders_v2"
    assert not catalog.table_exists(spark, name)
    assert catalog.apply_contract(spark, c.SALES_ORDERS_V2, name)
    assert not catalog.apply_contract(spark, c.SALES_ORDERS_V2, name)
    assert catalog.table_exists(spark, name)
    facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert facts["Comment"] == c.SALES_ORDERS_V2.comment
    assert "write.format.default=parquet" in facts["Table Properties"]
    comments = {r[0]: r[2] for r in spark.sql(f"DESCRIBE {name}").collect()}
    assert comments["order_ts"] == "Order placement time, UTC"
    stored = catalog.read_contract(spark, c.SALES_ORDERS_V2, name)
    assert c.differences(stored.schema, c.SALES_ORDERS_V2, strict=False) == []


def test_existing_table_is_left_alone(spark, namespace):
    name = f"{namespace}.orders_v2"
    spark.sql(f"CREATE TABLE {name} (other STRING) USING parquet")
    assert not catalog.apply_contract(spark, c.SALES_ORDERS_V2, name)
    assert catalog.read_table(spark, name).columns == ["other"]


def test_text_in_ddl_is_quoted(spark, namespace):
    contract = c.TableContract(
        f"{namespace}.odd", c.SALES_ORDERS.schema, comment="it's \\ odd", properties={"a'b": 5}
    )
    catalog.apply_contract(spark, contract)
    facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {contract.name}").collect()}
    assert facts["Comment"] == "it's \\ odd"
    assert "a'b=5" in facts["Table Properties"]


def test_namespaces(spark, namespace):
    catalog.ensure_namespace(spark, namespace)
    assert catalog.list_namespaces(spark).filter(F.col("namespace") == namespace).count() == 1


def test_current_catalog(spark):
    catalog.use_catalog(spark, "spark_catalog")
    assert catalog.in_session_catalog(spark, "sales.orders")
    assert catalog.in_session_catalog(spark, "spark_catalog.sales.orders")
    assert not catalog.in_session_catalog(spark, "other.sales.orders")


def test_append_matches_columns_by_name(spark, namespace):
    name = f"{namespace}.orders"
    catalog.apply_contract(spark, c.SALES_ORDERS, name)
    frame = spark.createDataFrame(pd.DataFrame([[1, "acme-corp", 199.99]], columns=["order_id", "customer", "amount"]))
    assert [f.dataType.simpleString() for f in frame.schema] == ["bigint", "string", "double"]
    catalog.append_rows(frame, name)
    catalog.append_rows(frame.select("amount", "customer", "order_id"), name, c.SALES_ORDERS)
    assert [tuple(r) for r in catalog.read_table(spark, name).collect()] == [(1, "acme-corp", 199.99)] * 2


def test_append_needs_the_table_and_its_columns(spark, namespace):
    name = f"{namespace}.orders"
    frame = spark.createDataFrame([(1, "a", 1.0)], c.SALES_ORDERS.schema)
    with pytest.raises(ValueError, match="does not exist"):
        catalog.append_rows(frame, name)
    catalog.apply_contract(spark, c.SALES_ORDERS, name)
    with pytest.raises(Exception):
        catalog.append_rows(frame.drop("customer"), name)
    assert catalog.read_table(spark, name).isEmpty()


def test_forbidden_row_keeps_the_whole_write_out(spark, namespace):
    name = f"{namespace}.orders_v2"
    catalog.apply_contract(spark, c.SALES_ORDERS_V2, name)
    noon = datetime(2024, 5, 1, 12)
    rows = [(i, "a", 1.0, noon) for i in range(50)] + [(50, None, 1.0, noon)]
    with pytest.raises(Exception, match="value missing or outside"):
        catalog.append_rows(orders(spark, rows), name, c.SALES_ORDERS_V2)
    assert catalog.read_table(spark, name).isEmpty()


def test_create_from_query_once(spark, namespace):
    name = f"{namespace}.orders_v4"
    frame = spark.createDataFrame([(1, 2.0)], "order_id long, amount double")
    catalog.create_from(frame, name)
    assert catalog.read_table(spark, name).collect() == frame.collect()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalog.create_from(frame, name)


def test_seed_never_repeats(spark, namespace):
    name = f"{namespace}.orders"
    catalog.apply_contract(spark, c.SALES_ORDERS, name)
    seed = spark.createDataFrame(c.SALES_ORDERS_SEED, c.SALES_ORDERS.schema)
    assert catalog.seed_if_empty(seed, name)
    assert not catalog.seed_if_empty(seed, name)
    stored = catalog.read_table(spark, name).orderBy("order_id").collect()
    assert tuple(stored[0]) == (1, "acme-corp", 1250.0)
    assert [tuple(r) for r in stored] == c.SALES_ORDERS_SEED


def test_days_are_read_without_opening_others(spark, namespace):
    name = f"{namespace}.orders_v2"
    catalog.apply_contract(spark, c.SALES_ORDERS_V2, name)
    rows = [
        (day * 10 + hour, "a", 1.0, datetime(2024, 5, day, hour)) for day in (1, 2, 3, 4) for hour in (0, 23)
    ]
    catalog.append_rows(orders(spark, rows), name, c.SALES_ORDERS_V2)
    found = catalog.read_days(spark, c.SALES_ORDERS_V2, "2024-05-02", "2024-05-03", name)
    assert found.columns == c.SALES_ORDERS_V2.schema.fieldNames()
    assert sorted(r["order_id"] for r in found.collect()) == [20, 30, 43, 53]
    files = {r[0] for r in found.select("_metadata.file_path").distinct().collect()}
    assert all("order_day=2024-05-02" in f or "order_day=2024-05-03" in f for f in files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_day" in plan


def test_append_by_name_alone_keeps_days(spark, namespace):
    name = f"{namespace}.orders_v2"
    catalog.apply_contract(spark, c.SALES_ORDERS_V2, name)
    rows = orders(spark, [(1, "a", 1.0, datetime(2024, 5, 1)), (2, "b", 2.0, datetime(2024, 5, 2))])
    rows = c.conform(rows, c.SALES_ORDERS_V2)
    catalog.append_rows(rows.select("order_ts", "amount", "customer", "order_id"), name)
    found = catalog.read_days(spark, c.SALES_ORDERS_V2, "2024-05-02", "2024-05-02", name)
    assert [r["order_id"] for r in found.collect()] == [2]
    stored = catalog.read_contract(spark, c.SALES_ORDERS_V2, name)
    assert c.differences(stored.schema, c.SALES_ORDERS_V2, strict=False) == []


def test_all_contracts_in_one_call(spark, namespace):
    moved = [replace(k, name=f"{namespace}.{k.name.rsplit('.', 1)[1]}") for k in c.CONTRACTS]
    seeds = {f"{namespace}.orders": c.SALES_ORDERS_SEED}
    first = catalog.apply_contracts(spark, moved, [namespace], seeds).collect()
    assert [tuple(r) for r in first] == [(k.name, True, k.name in seeds) for k in moved]
    again = catalog.apply_contracts(spark, moved, [namespace], seeds).collect()
    assert [tuple(r) for r in again] == [(k.name, False, False) for k in moved]
    assert catalog.read_table(spark, f"{namespace}.orders").count() == 5


# -- rows that a table refuses, kept beside the others -------------------------

NOON = datetime(2024, 5, 1, 12)
MIXED = [
    (1.0, "a", 10.0, NOON),
    (2.5, "b", 11.0, NOON),
    (3.0, None, None, NOON),
    (4.0, "d", 1e9, datetime(2024, 5, 2, 1)),
    (None, "e", 1.5, None),
    (6.0, "f", 2.0, datetime(2024, 5, 2, 1)),
]


def mixed(spark, rows=MIXED):
    return spark.createDataFrame(rows, "order_id double, customer string, amount double, order_ts timestamp")


def judged_table(spark, namespace, contract=c.SALES_ORDERS_V2):
    name = f"{namespace}.judged"
    assert catalog.apply_contract(spark, contract, name, keep_refused=True)
    return name


def test_refused_rows_are_stored_and_counted_in_the_write(spark, namespace):
    name = judged_table(spark, namespace)
    counts = catalog.append_judged(mixed(spark), name, c.SALES_ORDERS_V2)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, c.violations(mixed(spark), c.SALES_ORDERS_V2).collect()))
    kept = catalog.read_contract(spark, c.SALES_ORDERS_V2, name)
    assert sorted(r["order_id"] for r in kept.collect()) == [1, 6]
    assert c.matches(kept, c.SALES_ORDERS_V2, strict=False)
    refused = catalog.read_refused(spark, name)
    row = F.from_json("refused_row", mixed(spark).schema)
    found = {(r["refused_reason"], r["order_id"]) for r in refused.select("refused_reason", row.alias("r")).select("refused_reason", "r.*").collect()}
    assert found == {("order_id: unfit", 2.5), ("customer: missing", 3.0), ("amount: unfit", 4.0), ("order_id: missing", None)}
    back = refused.select(row.alias("r")).select("r.*")
    assert back.exceptAll(mixed(spark)).isEmpty() and back.count() == 4


def test_a_judged_write_reads_its_input_once(spark, namespace):
    name = judged_table(spark, namespace)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    many = mixed(spark, MIXED * 500).repartition(4)
    source = many.mapInPandas(counted, many.schema)
    counts = {r["column_name"]: (r["null_rows"], r["unfit_rows"]) for r in catalog.append_judged(source, name, c.SALES_ORDERS_V2).collect()}
    assert read.value == 3000
    assert counts == {"order_id": (500, 500), "customer": (500, 0), "amount": (500, 500), "order_ts": (500, 0)}
    assert catalog.read_contract(spark, c.SALES_ORDERS_V2, name).count() == 1000
    assert catalog.read_refused(spark, name).count() == 2000


def test_reading_the_contract_opens_no_refused_partition(spark, namespace):
    name = judged_table(spark, namespace)
    catalog.append_judged(mixed(spark), name, c.SALES_ORDERS_V2)
    files = catalog.read_contract(spark, c.SALES_ORDERS_V2, name).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("refused_reason=__HIVE_DEFAULT_PARTITION__" in r["f"] for r in files)
    days = catalog.read_days(spark, c.SALES_ORDERS_V2, "2024-05-01", "2024-05-02", name)
    assert days.columns == c.SALES_ORDERS_V2.schema.fieldNames() and days.count() == 2
    plain = spark.createDataFrame([(7, "g", 3.0, NOON)], "order_id long, customer string, amount double, order_ts timestamp")
    catalog.append_rows(plain, name, c.SALES_ORDERS_V2)
    assert catalog.read_contract(spark, c.SALES_ORDERS_V2, name).count() == 3 and catalog.read_refused(spark, name).count() == 4


def test_judged_writes_of_clean_refused_and_no_rows(spark, namespace):
    name = judged_table(spark, namespace)
    for rows, kept, refused in ((MIXED[:1], 1, 0), (MIXED[1:2], 1, 1), ([], 1, 1)):
        counts = catalog.append_judged(mixed(spark, rows), name, c.SALES_ORDERS_V2)
        assert counts.agg(F.sum(F.col("null_rows") + F.col("unfit_rows"))).first()[0] == (refused if rows == MIXED[1:2] else 0)
        assert catalog.read_contract(spark, c.SALES_ORDERS_V2, name).count() == kept
        assert catalog.read_refused(spark, name).count() == refused
    with pytest.raises(ValueError, match="unknown"):
        catalog.append_judged(mixed(spark).withColumn("more", F.lit(1)), name, c.SALES_ORDERS_V2)
    plain = f"{namespace}.plain"
    catalog.apply_contract(spark, c.SALES_ORDERS_V2, plain)
    with pytest.raises(ValueError, match="keeps no refused rows"):
        catalog.append_judged(mixed(spark), plain, c.SALES_ORDERS_V2)


def test_a_contract_without_days_keeps_refused_rows_too(spark, namespace):
    name = judged_table(spark, namespace, c.SALES_ORDERS)
    rows = spark.createDataFrame([(1.0, "a", 1.0), (1.5, "b", 2.0)], "order_id double, customer string, amount double")
    catalog.append_judged(rows, name, c.SALES_ORDERS)
    assert [r["order_id"] for r in catalog.read_contract(spark, c.SALES_ORDERS, name).collect()] == [1]
    assert [r["refused_reason"] for r in catalog.read_refused(spark, name).collect()] == ["order_id: unfit"]


# -- days that another table names --------------------------------------------


def test_listed_days_open_only_their_partitions(spark, namespace):
    contract = c.SALES_ORDERS_V3
    name = f"{namespace}.daily"
    catalog.apply_contract(spark, contract, name)
    rows = [(i, float(i), datetime(2024, 5, 1 + i % 20, 3)) for i in range(200)]
    frame = spark.createDataFrame(rows, "order_id long, amount double, order_ts timestamp")
    catalog.append_rows(frame, name, contract)
    days = spark.createDataFrame([(datetime(2024, 5, 3), 9), (datetime(2024, 5, 3), 9), (datetime(2024, 5, 7), 9), (datetime(2024, 6, 1), 9), (None, 9), (datetime(2024, 5, 9), 1)], "at timestamp, n int")
    found = catalog.read_listed_days(spark, contract, days.filter("n > 5"), "at", name)
    assert found.columns == contract.schema.fieldNames()
    assert sorted(r["order_id"] for r in found.collect()) == [i for i in range(200) if i % 20 in (2, 6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    # files of other days can be broken without harm
    place = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Location'").first()["data_type"].removeprefix("file:")
    for path in glob.glob(f"{place}/order_day=2024-05-1*/*.parquet"):
        with open(path, "wb") as broken:
            broken.write(b"x" * 50)
    spark.catalog.refreshTable(name)
    assert catalog.read_listed_days(spark, contract, days.filter("n > 5"), "at", name).count() == 20
    assert catalog.read_listed_days(spark, contract, days.filter("n > 50"), "at", name).count() == 0
