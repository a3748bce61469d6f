"""Sessions of an operator's own, beside the caller's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def own_session(spark: SparkSession, **settings: object) -> SparkSession:
    """A session with the caller's settings, apart from those named, and no temporary views.

    It shares the catalog, the executors and cached data; what is set or registered
    there leaves the caller's session as it is. Double underscores stand for dots.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    for name, value in settings.items():
        own.conf.set(name.replace("__", "."), str(value))
    return own
