from types import SimpleNamespace

from tablewright.sources.scratch import drop_scratch, scratch_folder, scratch_root


def session(**settings):
    known = {f"spark.{key.replace('_', '.')}": value for key, value in settings.items()}
    return SimpleNamespace(conf=known)


def test_scratch_is_new_and_below_the_named_folder():
    cluster = session(checkpoint_dir="hdfs://shared/tmp/")
    first, second = scratch_folder(cluster, "x"), scratch_folder(cluster, "x")
    assert first != second
    assert first.startswith("hdfs://shared/tmp/tablewright/x-")


def test_without_one_it_is_below_the_warehouse():
    assert scratch_folder(session(sql_warehouse_dir="s3://house/"), "x").startswith("s3://house/_scratch/tablewright/x-")


def test_scratch_can_be_dropped(spark):
    path = scratch_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    drop_scratch(spark)
    spark.range(1).write.parquet(path)  # the folder is free again
    assert scratch_root(spark) in path


def test_only_namespaces_of_the_library_are_dropped(spark, tmp_path):
    spark.sql(f"CREATE NAMESPACE run_reports LOCATION '{tmp_path}/reports'")
    spark.sql("CREATE TABLE run_reports.t USING parquet AS SELECT 1 AS a")
    spark.sql(f"CREATE NAMESPACE run_own LOCATION '{scratch_folder(spark, 'tables')}'")
    left = f"{scratch_root(spark)}-llm/rows-1"
    spark.range(3).write.parquet(left)
    try:
        drop_scratch(spark)
        names = {r[0] for r in spark.sql("SHOW NAMESPACES").collect()}
        assert "run_reports" in names and "run_own" not in names
        assert spark.table("run_reports.t").count() == 1
        spark.range(1).write.parquet(left)
    finally:
        spark.sql("DROP NAMESPACE run_reports CASCADE")
