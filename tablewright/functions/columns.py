"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    IntegralType,
    NullType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

MOMENTS = (DateType, TimestampType, TimestampNTZType)


def day_of(ts: Column | str) -> Column:
    """The calendar day a timestamp falls on."""
    return F.to_date(ts)


def load_time(at: datetime | None = None) -> Column:
    """``at``, or the time the query started (one value for the whole query)."""
    return F.current_timestamp() if at is None else F.lit(at)


def options_map(**options: object) -> Column:
    """A string-to-string map; values are written as text."""
    pairs = [F.lit(str(part)) for item in options.items() for part in item]
    return F.create_map(*pairs).cast("map<string,string>")


def assignable(have: DataType, want: DataType) -> bool:
    """Whether a by-name append would take this pair of types.

    Numbers go into numbers, dates and timestamps into each other, any plain value
    into text; nested types only into themselves.
    """
    if have == want or isinstance(have, NullType):
        return True
    if isinstance(want, StringType):
        return isinstance(have, (NumericType, BooleanType, BinaryType, StringType, *MOMENTS))
    return any(isinstance(have, kind) and isinstance(want, kind) for kind in (NumericType, MOMENTS))


def converted(value: Column, have: DataType, want: DataType) -> Column:
    """``value`` as ``want``; NULL where that cannot hold it.

    An integer does not hold a fraction. A decimal rounds to its scale.
    """
    cast = value.try_cast(want)
    if isinstance(want, IntegralType) and isinstance(have, NumericType) and not isinstance(have, IntegralType):
        return F.when(value % F.lit(1) == 0, cast)
    return cast


def fits(value: Column, have: DataType, want: DataType) -> Column:
    """True unless a present value has no counterpart in ``want``."""
    return value.isNull() | converted(value, have, want).isNotNull()


def _filler(data_type: DataType) -> Column | None:
    """Some value of a plain type that Spark knows is not NULL."""
    if isinstance(data_type, (StringType, BinaryType)):
        return F.lit("").cast(data_type)
    if isinstance(data_type, DateType):
        return F.lit(date(1970, 1, 1))
    if isinstance(data_type, MOMENTS):
        return F.lit(datetime(1970, 1, 1)).cast(data_type)
    if isinstance(data_type, (BooleanType, NumericType)):
        return F.lit(False).cast(data_type)
    return None


def checked(value: Column, have: DataType, want: DataType, nullable: bool, label: str) -> Column:
    """``value`` as ``want``; the job fails on a value that may not be stored.

    The check is part of the projection, so a write that carries it reads its
    input once and commits nothing when a row breaks the rule. A required column
    of a plain type is not nullable: behind the failing check stands a value that
    no row ever takes.
    """
    cast = converted(value, have, want)
    refuse = F.raise_error(F.lit(f"{label}: value missing or outside {want.simpleString()}"))
    if nullable:
        return F.when(value.isNull(), F.lit(None).cast(want)).otherwise(F.coalesce(cast, refuse))
    filler = _filler(want)
    return F.coalesce(cast, refuse) if filler is None else F.coalesce(cast, refuse, filler)


def ancestor_paths(path: Column | str) -> Column:
    """``a.b.c`` as ``[a, a.b, a.b.c]``: the path and everything above it."""
    steps = F.split(path, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda depth: F.array_join(F.slice(steps, F.lit(1), depth), "."),
    )


def parent_path(path: Column | str) -> Column:
    """The namespace part of a path; NULL for a path of one step."""
    steps = F.split(path, r"\.")
    above = F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), ".")
    return F.when(F.size(steps) > 1, above)


def leaf_name(path: Column | str) -> Column:
    """The last step of a path."""
    return F.element_at(F.split(path, r"\."), -1)


def directory_of(file_path: Column) -> Column:
    """The directory of a scanned file, as a path that a reader accepts.

    File metadata holds percent-encoded paths, in which ``+`` stands for itself.
    """
    folder = F.regexp_replace(file_path, r"/[^/]+$", "")
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


def day_literal(day: date | str) -> Column:
    return F.lit(str(day)).cast("date")
