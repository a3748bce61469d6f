"""Token ids as length-delimited binary records, and an offset index beside them.

A record file is a run of frames:

    8 bytes   length of the payload, little-endian
    4 bytes   masked checksum (Castagnoli) of those 8 bytes
    n bytes   payload: 1 byte (1: an id is there, 2: token ids of 4 bytes), 8 bytes id,
              then token ids of 2 bytes each, or of 4 where a vocabulary needs them
    4 bytes   masked checksum of the payload
    1 byte    0x0A, which ends a frame

Frames are written by Spark's own file writer, so a task that runs twice leaves one
file, and any store that Spark reaches can hold them.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.checksums import crc32c, masked
from tablewright.llm.shared import bounds, ragged, text_or_empty, text_slices
from tablewright.llm.token_ids import encoder

FILE_BYTES = 32 << 20
SLICE = 2 << 20  # bytes of text that a task encodes together
HEAD, TAIL, PREFIX = 12, 5, 9
KNOWN, WIDE = 1, 2
INDEX = (
    "doc_id bigint, file int, offset bigint, frame_bytes bigint, tokens_before bigint, "
    "n_tokens bigint, ids_crc32 bigint"
)


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES
) -> None:
    """Encodes ``docs(doc_id, text)`` and writes files and index below ``folder``.

    ``data`` holds record files in ascending doc_id order, file by file and within
    each; ``index`` has one row per record. NULL text counts as empty and gives the
    end id alone; a NULL doc_id comes first and is kept as NULL; repeated ids stand
    side by side, and a doc_id that many rows have is cut over files. Other columns are
    not looked at. An empty table gives no records.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    among = [F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(max(1, -(-size * 2 // file_bytes)), "doc_id", *among).sortWithinPartitions("doc_id", "text")

    frames = functools.partial(_encoded, tokenizer=tokenizer, end_id=end_id)
    lines = ordered.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").text(f"{folder}/data")
    scan_records(docs.sparkSession, folder).write.parquet(f"{folder}/index")


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """The frames of a task's ``doc_id, text`` rows.

    The worker's encoder forgets the words of the task when it ends, so that what a
    reused worker keeps does not grow with the tasks that it has run.
    """
    texts = encoder(tokenizer)
    width = 2 if max(end_id + 1, texts.tokenizer.get_vocab_size()) <= 1 << 16 else 4
    try:
        for part in text_slices(batches, "text", SLICE):
            ids, ends = texts.encode(part.column("text"))
            yield pa.record_batch([_framed(part.column("doc_id"), ids, ends, end_id, width)], ["frame"])
    finally:
        texts.forget()


def _framed(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, end_id: int, width: int) -> pa.Array:
    """The frames of a batch, without the byte that the writer adds."""
    counts = np.diff(ends) + 1
    lengths = PREFIX + width * counts
    frame = HEAD + lengths + TAIL - 1
    starts = bounds(frame)
    data = np.zeros(int(starts[-1]), np.uint8)
    at = starts[:-1]

    def put(where: np.ndarray, values: np.ndarray) -> None:
        data[where[:, None] + np.arange(values.dtype.itemsize)] = values.view(np.uint8).reshape(len(values), -1)

    whole = np.insert(ids.astype(f"<u{width}"), ends[1:], end_id)
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    put(at, lengths.astype("<u8"))
    data[at + HEAD] = known * KNOWN + (width == 4) * WIDE
    put(at + HEAD + 1, doc_ids.fill_null(0).to_numpy().astype("<i8"))
    data[ragged(at + HEAD + PREFIX, width * counts)] = whole.view(np.uint8)
    put(at + 8, masked(crc32c(data, at, np.full(len(at), 8))).astype("<u4"))
    put(at + HEAD + lengths, masked(crc32c(data, at + HEAD, lengths)).astype("<u4"))
    return pa.Array.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record as the files hold it, every length and checksum verified.

    ``file`` is the number in the file's name, ``tokens_before`` counts within the file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("int")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                yield _parsed(number, np.frombuffer(content.as_buffer(), np.uint8))

    return files.select(number.alias("file"), "content").mapInArrow(parsed, INDEX)


def _parsed(number: int, data: np.ndarray) -> pa.RecordBatch:
    raw, at, found = data.data, 0, []
    while at < len(data):
        (length,) = struct.unpack_from("<Q", raw, at)
        if at + HEAD + length + TAIL > len(data) or data[at + HEAD + length + TAIL - 1] != 0x0A:
            raise ValueError(f"file {number}: no whole record at byte {at}")
        found.append((at, length))
        at += HEAD + length + TAIL
    starts = np.array([f[0] for f in found], np.int64)
    lengths = np.array([f[1] for f in found], np.int64)

    def stored_at(where: np.ndarray) -> np.ndarray:
        return data[where[:, None] + np.arange(4)].view("<u4").reshape(-1)

    wrong = stored_at(starts + 8) != masked(crc32c(data, starts, np.full(len(starts), 8)))
    wrong |= stored_at(starts + HEAD + lengths) != masked(crc32c(data, starts + HEAD, lengths))
    if wrong.any():
        raise ValueError(f"file {number}: wrong checksum at byte {starts[np.flatnonzero(wrong)[0]]}")
    doc_ids = data[(starts + HEAD + 1)[:, None] + np.arange(8)].view("<i8").reshape(-1)
    flags = data[starts + HEAD]
    counts = (lengths - PREFIX) // np.where(flags & WIDE, 4, 2)
    sums = [
        zlib.crc32(_ids(raw[a + HEAD : a + HEAD + n])) for a, n in zip(starts.tolist(), lengths.tolist())
    ]
    columns = [
        pa.array(doc_ids, pa.int64(), mask=flags & KNOWN == 0),
        pa.array(np.full(len(starts), number, np.int32)),
        pa.array(starts),
        pa.array(HEAD + lengths + TAIL),
        pa.array(bounds(counts)[:-1]),
        pa.array(counts),
        pa.array(np.array(sums, np.int64)),
    ]
    return pa.record_batch(columns, INDEX.replace(",", "").split()[::2])


def _ids(payload: bytes | memoryview) -> np.ndarray:
    """The token ids of a payload, 4 bytes each."""
    return np.frombuffer(payload, "<u4" if payload[0] & WIDE else "<u2", offset=PREFIX).astype("<u4")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: the ids of all records in earlier files and earlier in the file."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    # one row per file, each of FILE_BYTES or so: the only thing that is put in one order
    before = F.sum("file_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    earlier = files.select("file", F.coalesce(before, F.lit(0)).alias("earlier"))
    return index.join(earlier, "file").select("*", (F.col("earlier") + F.col("tokens_before")).alias("start"))


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """``doc_id, ids`` of all records in an order drawn by ``seed``.

    The index says where each record is. Its rows of a file are put in random order and
    the frames fetched at their offsets, each with its lengths and checksums verified; no
    frame is looked for. A file's rows of the index are bounded as the file is. What the
    files give is then put in one random order.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("int")
    places = F.collect_list(F.struct("offset", "frame_bytes", "doc_id")).alias("places")
    wanted = spark.read.schema(INDEX).parquet(f"{folder}/index").groupBy("file").agg(places)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content, places in zip(batch.column("file").to_pylist(), batch.column("content"), batch.column("places")):
                data, rows = content.as_buffer(), places.values
                at, sizes = (rows.field(name).to_numpy() for name in ("offset", "frame_bytes"))
                by_place = np.argsort(at)
                order = by_place[np.random.default_rng([seed, number]).permutation(len(at))]
                ids = _frames(number, np.frombuffer(data, np.uint8), at[order], sizes[order])
                yield pa.record_batch([rows.field("doc_id").take(pa.array(order)), ids], ["doc_id", "ids"])

    read = files.select(number.alias("file"), "content").join(wanted, "file")
    return read.mapInArrow(drawn, "doc_id bigint, ids array<bigint>").orderBy(F.rand(seed))


def _frames(number: int, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ids of the records at these places, in their order."""
    lengths = sizes - HEAD - TAIL
    outside = (at < 0) | (lengths < PREFIX) | (at + sizes > len(data))
    if outside.any():
        raise ValueError(f"file {number}: no whole record at byte {at[np.flatnonzero(outside)[0]]}")

    def held(where: np.ndarray, kind: str) -> np.ndarray:
        return data[where[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind).reshape(-1)

    wrong = held(at, "<u8") != lengths.astype(np.uint64)
    wrong |= held(at + 8, "<u4") != masked(crc32c(data, at, np.full(len(at), 8)))
    wrong |= held(at + HEAD + lengths, "<u4") != masked(crc32c(data, at + HEAD, lengths))
    if wrong.any():
        raise ValueError(f"file {number}: wrong checksum at byte {at[np.flatnonzero(wrong)[0]]}")
    raw = data.data
    ids = [_ids(raw[a + HEAD : a + HEAD + n]) for a, n in zip(at.tolist(), lengths.tolist())]
    ends = pa.array(bounds(np.array([len(i) for i in ids], np.int64)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)))
