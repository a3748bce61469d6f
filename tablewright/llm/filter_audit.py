"""How filters interact: which of them a document fails, and what each removes in every order of applying them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import schema_of, stored, text_or_empty, text_slices

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS = 200
UPPER, MARKS = re.compile(rb"[A-Z]"), re.compile(rb"[#$%&*|]")
COUNTED = ["rows", "good", "toxic"]
RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def own_failures(text: str) -> int:
    """The filters that a text fails by itself, a bit for each of A to D."""
    data = text.encode()
    words = data.split()  # at the six white space characters of ASCII, and at no others
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * len(UPPER.findall(data)) > 2 * len(text)
    marked = MARKS.search(data) is not None
    return few | repeated << 1 | loud << 2 | marked << 3


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, hash, part, mask, rows``: the filters that each document fails, one bit for each.

    A: under 200 words. B: fewer distinct words than half of all. C: more than 2 % of
    its characters are A to Z. D: holds one of ``#$%&*|``. E: a smaller doc_id anywhere in
    the table has the same text, whether or not another filter fails that.

    E comes from a left-semi join of the texts with themselves, on hash, exact text and
    smaller doc_id. Of each repeated text the right side holds one row, with its
    smallest doc_id: copies are merged before the shuffle, and a group of copies of any
    size is a hot key on the left side only, which adaptive execution splits. The ids
    from E and those that fail A to D are united and their bits combined.

    ``docs(doc_id, text)`` and the column named by ``part``; NULL counts as an empty text
    or part. A NULL doc_id is smaller than none and no other is smaller than it, so it
    neither fails E nor makes others fail. ``rows`` counts repeated rows of one doc_id,
    text and part, which pass or fail together. Other columns are not looked at. An
    empty table gives no rows.
    """
    own_id = schema_of(docs, "doc_id")
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    texts = texts.withColumn("hash", F.unhex(F.md5("text")))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            masks = pa.array(map(own_failures, batch.column("text").to_pylist()), pa.int32())
            yield pa.record_batch([*map(batch.column, ("doc_id", "hash", "part")), masks], ["doc_id", "hash", "part", "mask"])

    own = stored(texts.mapInArrow(judged, f"{own_id}, hash binary, part string, mask int"), "own_failures")
    firsts = stored(
        texts.groupBy("hash", "text")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter(F.col("first") < F.col("last")),
        "repeated",
    )
    left, right = texts.alias("left"), firsts.alias("right")
    same = (F.col("left.hash") == F.col("right.hash")) & (F.col("left.text") == F.col("right.text"))
    copies = left.join(right, same & (F.col("right.first") < F.col("left.doc_id")), "left_semi")
    copied = copies.select("doc_id", "hash", "part", F.lit(COPY).alias("mask"), F.lit(0).alias("rows"))
    united = own.withColumn("rows", F.lit(1)).unionByName(copied)
    return united.groupBy("doc_id", "hash", "part").agg(F.bit_or("mask").alias("mask"), F.sum("rows").alias("rows"))


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, rows, good, toxic``: documents by the filters they fail, at most 32 rows a part.

    ``labels(doc_id, quality, toxic)`` need not cover all documents. Where a doc_id has
    several labels, one that says 1 is enough; NULL labels and doc_ids say nothing.
    """
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    labelled = failed.join(said, "doc_id", "left")
    counted = [F.sum(F.when(F.col(c), F.col("rows")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return labelled.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), *counted)


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from :func:`failures`.

    ``kept`` documents are left after the step, ``removed`` go in it, ``redundant`` fail its
    filter but went earlier, ``unique_fails`` fail no other filter; ``good_lost`` and
    ``toxic_lost`` are the removed ones so labelled. ``shapley`` is what the step's filter
    removes in all orders together. Zeros are rows too. All are sums over a part's
    combinations, so no document is looked at again.
    """
    bit = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    steps = [("".join(order), i) for order in permutations(FILTERS) for i in range(len(FILTERS))]
    masks = np.arange(1 << len(FILTERS))[:, None]
    now = np.array([bit[order[i]] for order, i in steps])
    before = np.array([sum(bit[x] for x in order[:i]) for order, i in steps])
    fails, gone = (masks & now) > 0, (masks & before) > 0
    # 1 where documents of a combination count at a step
    kept, removed, redundant, only = (x.astype(np.int64) for x in (~fails & ~gone, fails & ~gone, fails & gone, masks == now))
    same_filter = (now[:, None] == now[None, :]).astype(np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, found in zip(batch.column("part").to_pylist(), batch.column("combinations").to_pylist()):
                counts = {c: np.zeros(len(masks), np.int64) for c in COUNTED}
                for entry in found:
                    for c in COUNTED:
                        counts[c][entry["mask"]] = entry[c]
                rows = counts["rows"]
                lost = rows @ removed
                numbers = [rows @ kept, lost, rows @ redundant, rows @ only]
                numbers += [counts["good"] @ removed, counts["toxic"] @ removed, lost @ same_filter]
                columns = [pa.array([name] * len(steps)), pa.array([o for o, _ in steps]), pa.array([i + 1 for _, i in steps], pa.int32())]
                yield pa.record_batch([*columns, *map(pa.array, numbers)], [f.split()[0] for f in RESULT.split(", ")])

    by_part = combinations(failed, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("combinations"))
    return by_part.mapInArrow(summed, RESULT)
