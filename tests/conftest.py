import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tablewright-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.checkpoint.dir", str(shared / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


@pytest.fixture
def namespace(spark, tmp_path):
    """A namespace of the test's own, gone when the test ends."""
    from tablewright.sources.catalog import ensure_namespace

    name = f"ns_{tmp_path.name}".replace("-", "_").replace("[", "_").replace("]", "_")
    ensure_namespace(spark, name, str(tmp_path / "warehouse"))
    yield name
    spark.sql(f"DROP NAMESPACE {name} CASCADE")
