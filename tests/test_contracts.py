from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.operators import contracts as c


def candidate(spark, rows):
    return spark.createDataFrame(rows, "amount double, order_id long, customer string, order_ts timestamp")


NOON = datetime(2024, 5, 1, 12)


def test_describe_lists_columns_in_order(spark):
    found = [tuple(r) for r in c.describe(spark, c.SALES_ORDERS_V2).collect()]
    assert found == [
        ("order_id", "bigint", False, "Primary key"),
        ("customer", "string", False, None),
        ("amount", "decimal(10,2)", False, None),
        ("order_ts", "timestamp", False, "Order placement time, UTC"),
    ]


def test_empty_has_the_exact_schema(spark):
    for contract in c.CONTRACTS:
        frame = c.empty(spark, contract)
        assert frame.isEmpty()
        assert c.matches(frame, contract)


def test_strict_comparison_sees_nullability_and_metadata(spark):
    schema = c.SALES_ORDERS_V3.schema
    relaxed = StructType([type(f)(f.name, f.dataType, True) for f in schema])
    assert c.differences(schema, c.SALES_ORDERS_V3) == []
    assert c.differences(relaxed, c.SALES_ORDERS_V3, strict=False) == []
    assert "order_id: nullable is True" in c.differences(relaxed, c.SALES_ORDERS_V3)
    assert "order_id: metadata differs" in c.differences(relaxed, c.SALES_ORDERS_V3)


def test_differences_name_columns_types_and_order():
    fields = {f.name: f for f in c.SALES_ORDERS.schema}
    swapped = StructType([fields["customer"], fields["order_id"], fields["amount"]])
    assert c.differences(swapped, c.SALES_ORDERS) == ["column order differs"]
    other = StructType().add("order_id", "string").add("amount", "double").add("extra", "long")
    assert c.differences(other, c.SALES_ORDERS) == [
        "missing column customer",
        "order_id: string instead of bigint",
        "unknown column extra",
    ]


def test_violations_count_missing_and_unfit_values(spark):
    rows = [
        (1.0, 1, "a", NOON),
        (None, 2, None, NOON),
        (1e9, 3, "c", NOON),
        (float("nan"), None, "d", NOON),
    ]
    found = {r[0]: (r[1], r[2]) for r in c.violations(candidate(spark, rows), c.SALES_ORDERS_V2).collect()}
    assert found == {"order_id": (1, 0), "customer": (1, 0), "amount": (1, 2), "order_ts": (0, 0)}


def test_violations_of_nothing_are_zero(spark):
    found = c.violations(c.empty(spark, c.SALES_ORDERS_V2), c.SALES_ORDERS_V2).collect()
    assert [(r["null_rows"], r["unfit_rows"]) for r in found] == [(0, 0)] * 4


def test_nullable_columns_may_hold_null(spark):
    frame = spark.createDataFrame([(None, None, None)], c.SALES_ORDERS.schema)
    assert all(r["null_rows"] == 0 for r in c.violations(frame, c.SALES_ORDERS).collect())
    assert c.conform(frame, c.SALES_ORDERS).collect() == frame.collect()


def test_conform_reorders_and_casts(spark):
    found = c.conform(candidate(spark, [(12.345, 1, "a", NOON)]), c.SALES_ORDERS_V2)
    assert found.columns == c.SALES_ORDERS_V2.schema.fieldNames()
    assert c.differences(found.schema, c.SALES_ORDERS_V2, strict=False) == []
    row = found.first()
    assert (str(row["amount"]), row["order_ts"]) == ("12.35", NOON)


@pytest.mark.parametrize("bad", [(None, 1, "a", NOON), (1e9, 1, "a", NOON), (1.0, 1, None, NOON)])
def test_conform_refuses_rows(spark, bad):
    with pytest.raises(Exception, match="value missing or outside"):
        c.conform(candidate(spark, [(1.0, 1, "a", NOON), bad]), c.SALES_ORDERS_V2).collect()


def test_conform_refuses_other_columns(spark):
    frame = candidate(spark, [(1.0, 1, "a", NOON)])
    with pytest.raises(ValueError, match="unknown"):
        c.conform(frame.withColumn("extra", F.lit(1)), c.SALES_ORDERS_V2)
    with pytest.raises(ValueError, match="missing"):
        c.conform(frame.drop("amount"), c.SALES_ORDERS_V2)


def test_zone_less_time_needs_a_utc_session(spark):
    frame = candidate(spark, [(1.0, 1, "a", NOON)]).withColumn("order_ts", F.lit(NOON).cast("timestamp_ntz"))
    assert c.conform(frame, c.SALES_ORDERS_V2).first()["order_ts"] == NOON
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="time zone"):
            c.conform(frame, c.SALES_ORDERS_V2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_day_column():
    assert c.SALES_ORDERS_V2.day_column == "order_day"


def test_conformed_frames_match_strictly(spark):
    found = c.conform(candidate(spark, [(12.5, 1, "a", NOON)]), c.SALES_ORDERS_V2)
    assert c.differences(found.schema, c.SALES_ORDERS_V2) == []
    frame = spark.createDataFrame([(1, None, 2.0)], c.SALES_ORDERS.schema)
    assert c.matches(c.conform(frame, c.SALES_ORDERS), c.SALES_ORDERS)


@pytest.mark.parametrize("value", ["'12'", "TIMESTAMP '2024-05-01 12:00:00'", "true", "array(1)"])
def test_unlike_types_are_refused_before_any_job(spark, value):
    frame = candidate(spark, [(1.0, 1, "a", NOON)]).withColumn("order_id", F.expr(value))
    for operator in (c.conform, c.violations):
        with pytest.raises(TypeError, match="order_id"):
            operator(frame, c.SALES_ORDERS_V2)


@pytest.mark.parametrize("value", ["1.7D", "1.7BD", "CAST(1.5 AS FLOAT)", "CAST('NaN' AS DOUBLE)", "1e30"])
def test_integers_take_no_fractions(spark, value):
    frame = candidate(spark, [(1.0, 1, "a", NOON)]).withColumn("order_id", F.expr(value))
    assert c.violations(frame, c.SALES_ORDERS_V2).filter("column_name = 'order_id'").first()["unfit_rows"] == 1
    with pytest.raises(Exception, match="value missing or outside"):
        c.conform(frame, c.SALES_ORDERS_V2).collect()


@pytest.mark.parametrize("value", ["7.0D", "7.00BD", "7", "7S"])
def test_whole_numbers_of_other_types_are_taken(spark, value):
    frame = candidate(spark, [(1.0, 1, "a", NOON)]).withColumn("order_id", F.expr(value))
    assert c.conform(frame, c.SALES_ORDERS_V2).first()["order_id"] == 7
