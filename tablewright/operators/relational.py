"""Projection, joins, sums, order and batch functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tablewright.functions.columns import load_time


# -- projection ---------------------------------------------------------------


def project(df: DataFrame, columns: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Columns by name, then new names for some of them."""
    return df.select(*columns).withColumnsRenamed(renames or {})


def doubled(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) * 2)


def stamped(df: DataFrame, name: str, at: datetime | None = None) -> DataFrame:
    return df.withColumn(name, load_time(at))


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: StructType | str,
) -> DataFrame:
    """Rows through a Python function, Arrow batch by Arrow batch.

    Nothing is pushed below this step and NaN comes back as NULL; a column
    expression is the better way wherever one exists.
    """
    return df.mapInPandas(fn, schema)


# -- joins --------------------------------------------------------------------


def anti_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` whose ``on`` value is not in ``right``; ``on`` comes first.

    A NULL key matches nothing, so its row stays. Both sides go to the join as they
    are, which lets adaptive execution split a key that holds many rows of ``left``.
    """
    return left.join(right.select(on), on, "left_anti")


def missing(desired: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ``desired`` keys that ``existing`` lacks, NULLs compared as values.

    One aggregation over both sides: copies of a key are merged before the
    shuffle, so a key that fills a third of the input is one row per task.
    """
    keys = list(keys)
    sides = desired.select(*keys, F.lit(False).alias("_held")).unionByName(
        existing.select(*keys, F.lit(True).alias("_held"))
    )
    return sides.groupBy(*keys).agg(F.bool_or("_held").alias("_held")).filter(~F.col("_held")).drop("_held")


def single(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with one row per key; a key that differs from itself fails the job that reads it.

    Copies of one row are merged, within each task before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    rows = df.distinct()
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    repeated = F.raise_error(F.concat(F.lit("more than one row for "), shown))
    one = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*others))).otherwise(repeated)
    return rows.groupBy(*keys).agg(one.alias("_row")).select(*keys, "_row.*")


def look_up(left: DataFrame, right: DataFrame, on: str | Sequence[str], required: bool = False) -> DataFrame:
    """``left`` with the columns of ``right``, whose keys are unique (:func:`single` sees to it).

    Rows without a partner are left out or, when ``required``, fail the job that
    reads the result. Catalyst picks the strategy from the sizes, and a sort-merge
    join is split at run time where a key of ``left`` is large.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not required:
        return left.join(right, keys, "inner")
    joined = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    shown = [F.concat(F.lit(f"no {k} "), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys]
    missed = F.raise_error(F.concat_ws(", ", *shown))
    # A filter, because a checked column would go unread where it is not needed.
    return joined.filter(F.when(F.col("_found"), F.lit(True)).otherwise(missed)).drop("_found")


# -- sums ---------------------------------------------------------------------


def sum_by(df: DataFrame, key: str, value: Column | str, name: str) -> DataFrame:
    """Sum per key, added up within each task before the shuffle."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


WIDTH, PIECES = 20, 4  # bits of a piece; pieces that hold the 53 bits of a double from its highest on
LEAST = -1074  # the exponent of the smallest double


def _unit(level: Column) -> Column:
    """The value of 1 in a piece of this level: a power of two, which no double is below."""
    return F.pow(F.lit(2.0), F.greatest(level * WIDTH, F.lit(LEAST)).cast("double"))


def exact_sum_by(df: DataFrame, keys: str | Sequence[str], value: Column | str, name: str) -> DataFrame:
    """The double nearest to the exact sum per key: the same bits in whatever order the rows come.

    A value is cut into whole numbers of 20 bits each, on a grid that is the same for all
    rows. They are added up as integers, exactly, by key and magnitude: within each task
    before the shuffle, so a key that fills a third of the rows is a few rows per task.
    Few magnitudes are left of a key, and only their exact total is rounded, once.

    As with ``sum``, NULLs are left out and no value at all gives NULL. NaN, or both
    infinities, give NaN. Sums beyond the largest double are infinite.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*[F.col(f"`{k}`") for k in keys], x.alias("_x"))
    finite = (F.abs("_x") < F.lit(float("inf"))) & ~F.isnan("_x")
    level = F.when(finite & (F.col("_x") != 0), F.floor(F.log2(F.abs("_x")) / WIDTH)).when(finite, F.lit(0)).cast("int")
    rows = rows.withColumn("_level", level).withColumn("_odd", F.when(~finite, F.col("_x")))
    rest = F.when(finite, F.col("_x"))
    for i in range(PIECES):
        unit = _unit(F.col("_level") - i)
        rows = rows.withColumn(f"_p{i}", F.when(rest >= 0, F.floor(rest / unit)).otherwise(F.ceil(rest / unit)).cast("bigint"))
        rows = rows.withColumn(f"_r{i}", rest - F.col(f"_p{i}") * unit)
        rest = F.col(f"_r{i}")
    named = [F.col(f"`{k}`") for k in keys]
    pieces = [F.sum(f"_p{i}").alias(f"_p{i}") for i in range(PIECES)]
    levels = rows.groupBy(*named, "_level").agg(*pieces, F.sum("_odd").alias("_odd"))
    parts = F.array(*[F.struct((F.col("_level") - i).alias("level"), F.col(f"_p{i}").alias("n")) for i in range(PIECES)])
    totals = levels.groupBy(*named).agg(
        F.flatten(F.collect_list(F.when(F.col("_level").isNotNull(), parts))).alias("_parts"), F.sum("_odd").alias("_odd")
    )
    found = F.when(F.col("_odd").isNotNull(), F.col("_odd")).when(F.size("_parts") > 0, _rounded(F.col("_parts")))
    return totals.select(*named, found.alias(name))


@F.pandas_udf(DoubleType())
def _rounded(parts: pd.Series) -> pd.Series:
    """The double nearest to a sum of whole numbers of units, exact in Python's integers."""

    def nearest(row: Sequence[dict]) -> float:
        total = sum(int(p["n"]) << (max(int(p["level"]) * WIDTH, LEAST) - LEAST) for p in row)
        try:
            return total / (1 << -LEAST)
        except OverflowError:
            return math.inf if total > 0 else -math.inf

    return parts.map(nearest, na_action="ignore")


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# -- order --------------------------------------------------------------------


def total_order(df: DataFrame, by: str) -> DataFrame:
    """All rows in ascending order of ``by``, NULLs first.

    Rows that tie are ordered by the input partition they come from, which lets
    the range shuffle cut through a value that fills many partitions.
    """
    return df.orderBy(F.col(by).asc_nulls_first(), F.spark_partition_id())


def first_rows(df: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The first ``n`` rows, of the order ``by`` when one is given."""
    return (df.orderBy(F.col(by).asc_nulls_first()) if by else df).limit(n)
