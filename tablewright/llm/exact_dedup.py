"""Exact duplicates by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored, text_or_empty

BLOCK = 256
END = 64
SPACE = r"[ \t-\r]+"
SHAPE = ["length", "head", "tail"]
RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def without_spaces(text: Column) -> Column:
    """The text without the six ASCII white space characters."""
    return F.regexp_replace(text, SPACE, "")


def duplicates(docs: DataFrame, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """Which row of each group of equal texts stays.

    Two texts are equal when they are identical without ASCII white space. Documents
    are first told apart by length and by their first and last characters; one that
    is alone with these is settled. All others are cut into blocks of ``block``
    characters. The distinct blocks are sorted, and a block's name is its place in
    that order; then the distinct pairs of adjacent names are sorted and named, and
    so on until each document has one name. No name comes from a hash, so different
    texts never meet. Every round works on distinct keys and one row per block, so a
    group of copies of any size only makes one key hot in a join that can be split.

    Returns one row per row of ``docs(doc_id, text)``: ``doc_id, keep_id, group_size,
    kept, text_sha256`` and the columns in ``carry``. Of equal texts the one with the
    most characters stays, then the smallest doc_id (NULL after all others); of rows
    that repeat both, one stays. NULL counts as an empty text. Other columns are not
    looked at. An empty table gives no rows.
    """
    # as one column, so that no carried name meets one of those below
    carried = F.struct(*carry) if carry else F.lit(0)
    rows = docs.select("doc_id", carried.alias("carried"), text_or_empty().alias("whole"))
    rows = rows.withColumn("bare", without_spaces(F.col("whole")))
    shaped = rows.select(
        "doc_id",
        "carried",
        F.length("whole").alias("size"),
        F.length("bare").alias("length"),
        F.substring("bare", 1, END).alias("head"),
        F.substring("bare", -END, END).alias("tail"),
        F.sha2("bare", 256).alias("text_sha256"),
        "bare",
    )
    ends = stored(shaped.drop("bare"), "ends")
    shared = stored(ends.groupBy(SHAPE).count().filter("count > 1").select(SHAPE), "shared")
    # the texts move once, whatever the size: a plan that sends the few shared shapes to
    # all tasks while they are few would end where they are many
    alike = stored(
        shaped.join(shared.hint("shuffle_hash"), SHAPE, "left_semi").drop("head", "tail").withColumn("row", F.monotonically_increasing_id()),
        "alike",
    )
    members = alike.drop("bare").join(_named_texts(alike, block), "row")
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = stored(
        members.groupBy("length", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    chosen = groups.select(
        "length", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")
    )
    grouped = members.join(chosen, ["length", "name"]).withColumn("kept", F.col("row") == F.col("keep_row"))
    alone = ends.join(shared, SHAPE, "left_anti").withColumns(
        {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}
    )
    columns = [*RESULT, *[F.col("carried")[c].alias(c) for c in carry]]
    return alone.select(columns).unionAll(grouped.select(columns))


def _named_texts(alike: DataFrame, block: int) -> DataFrame:
    """``row, name`` of all texts in ``alike``; equal for rows of one length if their texts are."""
    cut = F.regexp_extract_all("bare", F.lit(f"(?s)(.{{1,{block}}})"), F.lit(1))
    blocks = alike.select("row", F.when(F.length("bare") > 0, cut).otherwise(F.array(F.lit(""))).alias("blocks"))
    pieces = blocks.select("row", F.size("blocks").alias("left"), F.posexplode("blocks").alias("position", "block"))
    names = _names(pieces, ["block"])
    named = stored(pieces.join(names, "block").select("row", "left", "position", "name"), "named")
    most = named.agg(F.max("left")).first()[0] or 1
    done = [named.filter("left = 1")]
    while most > 1:
        at = F.col("position") % 2
        pairs = (
            named.filter("left > 1")
            .groupBy("row", F.expr("position div 2").alias("position"), F.expr("(left + 1) div 2").alias("left"))
            .agg(
                F.max(F.when(at == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(at == 1, F.col("name"))), F.lit(-1)).alias("second"),
            )
        )
        pairs = stored(pairs, "pairs")
        names = _names(pairs, ["first", "second"])
        named = stored(pairs.join(names, ["first", "second"]).select("row", "left", "position", "name"), "named")
        done.append(named.filter("left = 1"))
        most = (most + 1) // 2
    return reduce(DataFrame.unionAll, done).select("row", "name")


def _names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys in order, each with its place: an integer that grows along the order."""
    ordered = rows.select(keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("name", F.monotonically_increasing_id()), "names")
