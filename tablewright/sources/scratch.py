"""Places for tables that a job writes on the way to its result."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import SparkSession

FOLDER = "tablewright"


def scratch_root(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    Executors on other machines reach both.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    above = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{above.rstrip('/')}/{FOLDER}"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{label}-{uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Drops the namespaces that are stored below the scratch folders, then deletes those folders.

    A namespace of the caller's stays, whatever its name.
    """
    roots = [scratch_root(spark), f"{scratch_root(spark)}-llm"]
    for row in spark.sql("SHOW NAMESPACES").collect():
        facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE NAMESPACE `{row[0]}`").collect()}
        if any(_below(facts.get("Location", ""), root) for root in roots):
            spark.sql(f"DROP NAMESPACE IF EXISTS `{row[0]}` CASCADE")
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _below(location: str, root: str) -> bool:
    """Whether a place lies in a folder; ``file:/x``, ``file:///x`` and ``/x`` are one place."""
    plain = lambda place: re.sub(r"^file:/*", "/", place).rstrip("/")
    return plain(location).startswith(f"{plain(root)}/")
