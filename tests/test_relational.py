import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.functions.columns import ancestor_paths, leaf_name, options_map, parent_path
from tablewright.operators import relational as r

NAN = float("nan")


def test_anti_join_keeps_null_and_compares_decimal_as_double(spark):
    left = spark.createDataFrame(
        [(1, 2.1), (2, 3.0), (3, None), (4, NAN)], "order_id long, amount double"
    )
    right = spark.createDataFrame([("2.10",), (None,)], "amount string").select(
        F.col("amount").cast("decimal(10,2)")
    )
    found = r.anti_join(left, right, "amount")
    assert found.columns == ["amount", "order_id"]
    assert sorted(row["order_id"] for row in found.collect()) == [2, 3, 4]
    with_nan = r.anti_join(left, spark.createDataFrame([(NAN,)], "amount double"), "amount")
    assert sorted(row["order_id"] for row in with_nan.collect()) == [1, 2, 3]


def test_anti_join_with_nothing_on_either_side(spark):
    left = spark.createDataFrame([(1, "a")], "id long, k string")
    assert r.anti_join(left, left.limit(0), "k").count() == 1
    assert r.anti_join(left.limit(0), left, "k").count() == 0


@pytest.mark.parametrize("kind", ["string", "double", "decimal(12,2)", "timestamp", "date", "int", "boolean", "binary", "array", "struct"])
def test_anti_join_by_key_type(spark, kind):
    source = {
        "string": lambda c: c.cast("string"),
        "timestamp": lambda c: F.timestamp_seconds(c * 86400),
        "date": lambda c: F.date_from_unix_date(c.cast("int")),
        "boolean": lambda c: c % 2 == 0,
        "binary": lambda c: c.cast("string").cast("binary"),
        "array": lambda c: F.when(c.isNotNull(), F.array(c, c + 1)),
        "struct": lambda c: F.when(c.isNotNull(), F.struct(c.alias("x"), (c + 1).alias("y"))),
    }.get(kind, lambda c: c.cast(kind))
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id"))
    left = spark.range(0, 600, 1, 8).select("id", source(key).alias("k"))
    right = spark.range(0, 600, 4).select(source(F.col("id")).alias("k"))
    known = [row["k"] for row in right.collect()]
    kept = [row["id"] for row in r.anti_join(left, right, "k").collect()]
    assert sorted(kept) == sorted(row["id"] for row in left.collect() if row["k"] not in known)


def test_anti_join_takes_any_case_and_any_column_names(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "_known long, Key string")
    right = spark.createDataFrame([("a", 1)], "key string, _known long")
    assert [row["_known"] for row in r.anti_join(left, right, "key").collect()] == [2]


def test_both_zeros_are_one_key(spark):
    left = spark.range(0, 1000).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("k"))
    assert r.anti_join(left, spark.createDataFrame([(1.0,)], "k double"), "k").count() == 1000
    assert r.anti_join(left, spark.createDataFrame([(0.0,)], "k double"), "k").count() == 0


SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.shuffle.partitions": "64",
}


@pytest.fixture
def small_skew(spark):
    """Limits at which a few thousand rows count as a skewed partition."""
    old = {key: spark.conf.get(key) for key in SMALL_SKEW}
    for key, value in SMALL_SKEW.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("share", [3, 30])
@pytest.mark.parametrize("hot", [7, None])
def test_a_hot_key_of_an_anti_join_is_split(spark, small_skew, share, hot):
    ids = spark.range(0, 60_000, 1, 16)
    left = ids.select("id", F.when(F.col("id") % share == 0, F.lit(hot)).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 60_000, 2).filter("id <> 7").select(F.col("id").alias("k"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    found = r.anti_join(left, right, "k")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert found.count() == left.join(right, "k", "left_anti").count()
    found.collect()
    if hot is not None:  # Spark spreads rows with a NULL key itself
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()


def test_look_up(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, k string")
    right = spark.createDataFrame([("a", 10), ("c", 30)], "k string, w long")
    assert [tuple(row) for row in r.look_up(left, right, "k").collect()] == [("a", 1, 10)]
    found = r.look_up(left.filter("id = 1"), right, "k", required=True)
    assert [tuple(row) for row in found.collect()] == [("a", 1, 10)]
    for missing_id, name in ((2, "no k b"), (3, "no k NULL")):
        with pytest.raises(Exception, match=name):
            r.look_up(left.filter(f"id = {missing_id}"), right, "k", required=True).select("w").collect()


def test_a_hot_lookup_key_is_split_at_run_time(spark):
    ids = spark.range(0, 100_000, 1, 16)
    left = ids.select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"), "id")
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for required in (False, True):
            found = r.look_up(left, right, "k", required)
            assert len(found.collect()) == 100_000
            assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_single_merges_copies_and_refuses_a_repeated_key(spark):
    schema = "k string, w long"
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], schema)
    assert sorted(map(str, r.single(df, ["k"]).collect())) == sorted(map(str, df.distinct().collect()))
    with pytest.raises(Exception, match="more than one row for a"):
        r.single(df.union(spark.createDataFrame([("a", 9)], schema)), ["k"]).collect()


def test_missing_compares_nulls_and_ignores_copies(spark):
    schema = "g string, p string"
    desired = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("c", "z")], schema)
    existing = spark.createDataFrame([("b", None), ("d", "w")], schema)
    assert sorted(map(tuple, r.missing(desired, existing, ["g", "p"]).collect())) == [("a", "x"), ("c", "z")]


def test_sums(spark):
    df = spark.createDataFrame([(1, "1.10"), (1, "2.20"), (2, None)], "k long, v string")
    df = df.select("k", F.col("v").cast("decimal(10,2)").alias("v"))
    found = r.sum_by(df, "k", "v", "total")
    assert found.schema["total"].dataType.simpleString() == "decimal(20,2)"
    assert {row["k"]: row["total"] and str(row["total"]) for row in found.collect()} == {1: "3.30", 2: None}
    assert r.sum_by(df.withColumn("v", F.col("v").cast("double")), "k", "v", "t").schema["t"].dataType.simpleString() == "double"
    assert r.row_count(df).first()[0] == 3


def test_total_order_cuts_through_a_hot_value(spark):
    numbers = [random.Random(5).choice([7, 7, None, i]) for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in numbers], "v long").repartition(8)
    found = r.total_order(df, "v")
    values = [row["v"] for row in found.collect()]
    assert Counter(values) == Counter(numbers)
    assert values == sorted(values, key=lambda v: (v is not None, v))
    assert found.columns == ["v"]


def test_first_rows(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "v long")
    assert [row["v"] for row in r.first_rows(df, 2, "v").collect()] == [1, 2]
    assert r.first_rows(df, 2).count() == 2


def test_map_batches_turns_nan_into_null(spark):
    df = spark.createDataFrame([(1, NAN), (2, 2.5)], "id long, amount double")

    def shifted(batches):
        return (b.assign(amount=b["amount"].shift(1), n=len(b)) for b in batches)

    found = [tuple(row) for row in r.map_batches(df.coalesce(1), shifted, "id long, amount double, n int").collect()]
    assert [row[1] for row in found] in ([None, None], [None, None])
    native = {row["id"]: row["twice"] for row in r.doubled(df, "amount", "twice").collect()}
    assert native[2] == 5.0 and native[1] != native[1]


def test_load_time_is_one_value(spark):
    assert r.stamped(spark.range(0, 1000, 1, 8), "at").select("at").distinct().count() == 1
    fixed = datetime(2024, 1, 1, 12)
    assert r.stamped(spark.range(1), "at", fixed).first()["at"] == fixed


def test_project_and_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")
    assert r.project(df, ["c", "a"], {"c": "x"}).columns == ["x", "a"]


def test_paths(spark):
    df = spark.createDataFrame([("w.a.b.t",), ("w",)], "p string")
    found = df.select(ancestor_paths("p"), parent_path("p"), leaf_name("p")).collect()
    assert tuple(found[0]) == (["w", "w.a", "w.a.b", "w.a.b.t"], "w.a.b", "t")
    assert tuple(found[1]) == (["w"], None, "w")


def test_options_map(spark):
    row = spark.range(1).select(options_map(files=2, name="x").alias("m")).select("m", F.col("m")["none"]).first()
    assert row[0] == {"files": "2", "name": "x"} and row[1] is None


# -- exact sums ---------------------------------------------------------------


def bits(value):
    return None if value is None else value.hex()


def exact(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "k string, x double").repartition(parts)
    return {row["k"]: row["total"] for row in r.exact_sum_by(frame, "k", "x", "total").collect()}


def test_exact_sum_is_the_rounded_exact_total(spark):
    draw = random.Random(6)
    rows = []
    for k in range(60):
        spread = draw.choice([1, 10, 60, 600, 1000])
        rows += [(str(k), draw.uniform(-1, 1) * 2.0 ** draw.uniform(-spread, spread)) for _ in range(draw.choice([1, 5, 200]))]
    wanted = {}
    for k, x in rows:
        wanted.setdefault(k, []).append(x)
    found = exact(spark, rows)
    for k, values in wanted.items():
        assert bits(found[k]) == bits(math.fsum(values)), k


def test_exact_sum_of_every_power_of_two(spark):
    """The grid is exact from the smallest double to the largest, also just beside each power."""
    values = []
    for e in range(-1074, 1024):
        x = 2.0**e
        values += [x, -math.nextafter(x, math.inf), math.nextafter(x, 0.0)]
    rows = [(str(i), x) for i, x in enumerate(values)]
    found = exact(spark, rows)
    assert all(found[str(i)] == x for i, x in enumerate(values))
    assert bits(exact(spark, [("a", x) for x in values])["a"]) == bits(math.fsum(values))


def test_exact_sum_does_not_depend_on_order_or_partitions(spark):
    draw = random.Random(7)
    values = [draw.uniform(0, 1e5) for _ in range(5000)] + [1e18, -1e18, 1e-9]
    sums = set()
    for parts in (1, 2, 7):
        draw.shuffle(values)
        sums.add(bits(exact(spark, [("a", x) for x in values], parts)["a"]))
    assert sums == {bits(math.fsum(values))}
    assert exact(spark, [("a", 1e300), ("a", 1.0), ("a", -1e300)])["a"] == 1.0


def test_exact_sum_of_odd_values(spark):
    inf = math.inf
    rows = [("nan", NAN), ("nan", 1.0), ("inf", inf), ("inf", -5.0), ("both", inf), ("both", -inf), ("none", None)]
    rows += [("some", None), ("some", 2.5), (None, 0.5), (None, 0.25), ("zero", -0.0), ("large", 1.7e308), ("large", 1.7e308)]
    found = exact(spark, rows)
    assert math.isnan(found["nan"]) and math.isnan(found["both"])
    assert (found["inf"], found["none"], found["some"], found[None], found["zero"], found["large"]) == (inf, None, 2.5, 0.75, 0.0, inf)
    assert exact(spark, [("max", 1.7e308), ("max", 1.7e308), ("max", -1.7e308)])["max"] == 1.7e308
    assert r.exact_sum_by(spark.createDataFrame([], "k string, x double"), "k", "x", "t").count() == 0


def test_exact_sum_takes_expressions_other_numbers_and_several_keys(spark):
    frame = spark.createDataFrame([(1, "a", 3), (1, "a", 4), (2, "b", 5)], "i long, `k 1` string, x int")
    found = r.exact_sum_by(frame, ["i", "k 1"], F.col("x") / 10, "t")
    assert found.columns == ["i", "k 1", "t"]
    assert sorted(map(tuple, found.collect())) == [(1, "a", 0.7), (2, "b", 0.5)]


def test_exact_sum_of_a_hot_key_is_a_few_rows_a_task(spark):
    frame = spark.range(0, 400_000, 1, 8).select(F.lit("hot").alias("k"), (F.col("id") / 7).alias("x"))
    found = r.exact_sum_by(frame, "k", "x", "t")
    assert "partial_sum" in found._jdf.queryExecution().executedPlan().toString()
    assert found.first()["t"] == math.fsum(i / 7 for i in range(400_000))
