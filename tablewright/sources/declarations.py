"""Access declarations as JSON documents, nested as people write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.access import SPEC


def read_declarations(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per document of ``groups`` and ``grants``, for ``access.declared_groups`` and ``declared_grants``.

    A file holds one document over any number of lines. What a document does not declare
    is NULL; what cannot be read as such a document fails the read.
    """
    return spark.read.schema(SPEC).option("multiLine", True).option("mode", "FAILFAST").json(list(paths))
