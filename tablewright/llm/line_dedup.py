"""Lines that many documents share: hashes range-partitioned, sorted and streamed; bitmaps of what stays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.shared import bounds, schema_of, stored, text_or_empty, text_slices

SPACE = b" \t\n\x0b\x0c\r"
LEAST_LENGTH, LEAST_DOCS = 40, 5
OCCURRENCE = "h0 bigint, h1 bigint, text_key binary, n_lines int, positions array<int>"
BITMAP = "text_key binary, n_lines int, n_dropped int, keep binary"


def text_key(text: Column | str) -> Column:
    """16 bytes that stand for a text beside its doc_id."""
    return F.unhex(F.md5(text))


def line_keys(text: str, least_length: int) -> tuple[int, dict[bytes, list[int]]]:
    """How many lines a text has, and the positions of each long line without outer white space, A-Z as a-z."""
    lines = text.encode().split(b"\n")
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(lines):
        if len(line) >= least_length and len(key := line.strip(SPACE)) >= least_length:
            if len(key) >= 4 * least_length or len(key.decode()) >= least_length:
                found.setdefault(key.lower(), []).append(at)
    return len(lines), found


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """What stays of each document that loses a line: ``doc_id, text_key, n_lines, n_dropped, keep``.

    A line's key is the line without ASCII white space at both ends, A-Z as a-z. Keys of
    at least ``least_length`` characters that at least ``least_docs`` documents hold lose
    all their lines, except in the largest doc_id that holds them. ``keep`` is a
    compressed bitmap with a bit per line, 1 where it stays (:func:`bitmap`,
    :func:`kept_lines`). Documents without a row keep every line.

    One row per document and key is range-partitioned by hash and doc_id and sorted, so a
    key that a third of all documents hold is cut over as many tasks as its rows fill. A
    task streams its rows: the first document of a key stays, later ones are dropped once
    enough documents are seen. Keys at the ends of a task's range, two at most, may go on
    in another task; their rows are settled after that, by sums over all of them.

    ``docs(doc_id, text)``; NULL texts count as empty. Rows of one doc_id count as one
    document and keep or lose a line together; NULL is a doc_id of its own, below all
    others. Other columns are not looked at. An empty table gives no rows.
    """
    own_id = schema_of(docs, "doc_id")

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            hashes, rows, sizes, positions, sizes_of = [], [], [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                n_lines, keys = line_keys(text, least_length)
                for key, at in keys.items():
                    hashes.append(xxhash.xxh3_128_digest(key))
                    rows.append(row)
                    sizes.append(n_lines)
                    positions += at
                    sizes_of.append(len(at))
            words = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            ends = pa.array(bounds(np.array(sizes_of, np.int64)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(positions, pa.int32()))
            own = [part.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "text_key")]
            columns = [own[0], pa.array(words[:, 0]), pa.array(words[:, 1]), own[1], pa.array(sizes, pa.int32()), lists]
            yield pa.record_batch(columns, ["doc_id", "h0", "h1", "text_key", "n_lines", "positions"])

    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_key", text_key("text"))
    held = stored(texts.mapInArrow(occurring, f"{own_id}, {OCCURRENCE}"), "lines")
    latest = F.col("doc_id").desc_nulls_last()
    ranged = held.repartitionByRange("h0", "h1", latest, "text_key").sortWithinPartitions("h0", "h1", latest)
    seen = stored(ranged.mapInArrow(_streamed(least_docs), f"{own_id}, {OCCURRENCE}, state int"), "seen")
    ends = seen.filter(F.col("state") != DROPPED)
    documents = F.count_distinct(F.struct("doc_id")) >= least_docs
    verdicts = ends.groupBy("h0", "h1").agg(
        (documents | F.bool_or(F.col("state") == MANY)).alias("many"), F.max("doc_id").alias("last")
    )
    # two keys per task at most
    open_rows = ends.filter(F.col("state") == OPEN).join(F.broadcast(verdicts.filter("many")), ["h0", "h1"])
    dropped = seen.filter(F.col("state") == DROPPED).select("doc_id", "text_key", "n_lines", "positions").unionAll(
        open_rows.filter(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "text_key", "n_lines", "positions")
    )
    # a set, so that repeated rows of one document are merged before the shuffle
    whole = dropped.groupBy("doc_id", "text_key", "n_lines").agg(F.flatten(F.collect_set("positions")).alias("positions"))
    return whole.mapInArrow(_mapped, f"{own_id}, {BITMAP}")


DROPPED, OPEN, MANY = 0, 1, 2


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; NULL equals NULL. The first does."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]


def _streamed(least_docs: int):
    """Rows sorted by key and document: the dropped ones, and those of the first and last key.

    ``OPEN`` rows may be dropped or not; a ``MANY`` row says that its key has enough
    documents, and which is the first of them.
    """

    def marked(rows: pa.Table, state: int) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            yield from rows.append_column("state", pa.array(np.full(rows.num_rows, state, np.int32))).to_batches()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None  # the key that the task began with
        begun = False
        many = None  # a row: the first document of the last key, where that has enough
        held = None  # the rows of the last key, where it has not
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            fresh = 0  # rows from here on are new; those before were held
            if many is not None or held is not None:
                before = many if many is not None else held
                fresh = before.num_rows
                rows = pa.concat_tables([before, rows])
            h0, h1 = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h0", "h1"))
            if not begun:
                begun, first = True, (h0[0], h1[0])
            start = np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
            change = start | _changes(rows.column("doc_id").combine_chunks())
            key = np.cumsum(start) - 1
            document = np.cumsum(change)
            at = np.flatnonzero(start)
            rank = document - document[at][key]  # 0: the first document of its key
            count = np.maximum.reduceat(rank, at) + 1
            enough = count >= least_docs
            if many is not None:
                enough[0] = True
            opening = (h0 == first[0]) & (h1 == first[1])
            last = key == key[-1]
            drop = enough[key] & (rank > 0) & ~opening
            drop[:fresh] &= many is None
            yield from marked(rows.filter(pa.array(drop)), DROPPED)
            fresh_opening = opening & (np.arange(len(key)) >= fresh)
            yield from marked(rows.filter(pa.array(fresh_opening)), OPEN)
            many = held = None
            if not opening[-1]:
                if enough[-1]:
                    many = rows.slice(int(at[-1]), 1)
                else:
                    held = rows.filter(pa.array(last)).combine_chunks()
        if many is not None:
            yield from marked(many, MANY)
        if held is not None:
            yield from marked(held, OPEN)

    return streamed


def bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: str, keep: bytes | None) -> str:
    """A text without the lines whose bit is 0; all of it where there is no bitmap."""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(lines[i] for i in np.flatnonzero(bits))


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, sizes = batch.column("positions"), batch.column("n_lines").to_pylist()
        maps, dropped = [], []
        for at, n_lines in enumerate(sizes):
            positions = lists[at].values.to_numpy(zero_copy_only=False)
            maps.append(bitmap(n_lines, positions))
            dropped.append(len(positions))
        columns = [batch.column("doc_id"), batch.column("text_key"), batch.column("n_lines")]
        columns += [pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())]
        yield pa.record_batch(columns, ["doc_id", "text_key", "n_lines", "n_dropped", "keep"])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, text, keep, row``, the row being all columns of ``docs`` as one."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_key(text_or_empty()).alias("text_key")).alias("rows")
    # the side that is hashed is the bitmaps, a row for each document; the texts are not sorted
    maps = bitmaps.select("doc_id", "text_key", "keep").alias("maps").hint("shuffle_hash")
    same = F.col("rows.doc_id").eqNullSafe(F.col("maps.doc_id")) & (F.col("rows.text_key") == F.col("maps.text_key"))
    return rows.join(maps, same, "left").select("rows.doc_id", text_or_empty("row.text").alias("text"), "keep", "row")


def without_repeats(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``bitmaps`` keeps; a NULL text stays NULL, other columns as they are."""

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            texts = map(kept_lines, part.column("text").to_pylist(), part.column("keep").to_pylist())
            yield pa.record_batch([part.column("row"), pa.array(texts, pa.string())], ["row", "short"])

    held = _with_bitmaps(docs, bitmaps).select("text", "keep", "row")
    short = held.mapInArrow(shortened, StructType().add("row", docs.schema).add("short", "string"))
    text = F.when(F.col("row")["text"].isNotNull(), F.col("short")).alias("text")
    return short.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row of ``docs(doc_id, text)``."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            before, after, marks = [], [], []
            for text, keep in zip(part.column("text").to_pylist(), part.column("keep").to_pylist()):
                before.append(text.count("\n") + 1)
                kept = before[-1]
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=before[-1])
                    kept, text = int(bits.sum()), kept_lines(text, keep)
                after.append(kept)
                marks.append(hashlib.sha256(text.encode()).hexdigest())
            n_lines, kept = pa.array(before, pa.int64()), pa.array(after, pa.int64())
            columns = [part.column("doc_id"), n_lines, pc.subtract(n_lines, kept), pa.array(marks, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    held = _with_bitmaps(docs.select("doc_id", "text"), bitmaps).select("doc_id", "text", "keep")
    return held.mapInArrow(digested, f"{schema_of(docs, 'doc_id')}, n_lines bigint, n_dropped bigint, kept_sha256 string")
