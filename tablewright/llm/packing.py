"""Packing by lexical retrieval: windows filled with a document's BM25 neighbours."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import bounds, ragged, stored, text_or_empty, text_slices
from tablewright.llm.token_ids import encoder

K1, B = 1.2, 0.75
SHARD_TOKENS, SHARDS_A_TASK = 500_000, 8
RUN = 6  # ids in a run of which a document is sampled
CUTS = "doc_id bigint, start bigint, doc_tokens bigint, length bigint, ids binary, term bigint, run bigint"
PIECES = "doc_id bigint, start bigint, doc_tokens bigint, length bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """All ids of ``docs(doc_id, text)``, dealt into sequences of at most ``window`` ids.

    A document's ids end with ``end_id``. Every full window's worth of them is a
    sequence of its own. What is left of each document, shorter than a window, is
    packed: documents are sorted over the cluster by samples of their terms
    (:func:`_signature`), so that those which share much stand together, and cut into
    shards of about ``shard_tokens``, some to a task. Each shard builds an inverted index with BM25
    weights, and a seed document takes its best unused neighbours until its window is
    full. The last neighbour is cut where the window ends; what remains of it is the next
    seed. What a shard has left at the end is cut into powers of two, so there is no
    padding. Document frequencies and the mean length cover all that is packed, over all
    shards; they are one number per token id, so the vocabulary bounds them. A group of
    copies of any size is cut over as many shards as it fills.

    One row per piece: ``doc_id, start`` (the document's ids before it), ``doc_tokens,
    length, sequence_id, offset`` (ids before it in the sequence), ``ids`` (4 bytes
    each, little-endian). NULL text counts as empty: the end id alone. Rows that
    repeat a doc_id, or have none, are documents of their own. Other columns are not
    looked at; an empty table gives no pieces.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            yield _cut(part, tokenizer, end_id, window)

    cut = stored(rows.mapInArrow(cuts, CUTS), "packing")
    row = F.monotonically_increasing_id()
    full = cut.filter(F.col("length") == window).withColumn("row", row)
    alone = full.select(
        "doc_id", "start", "doc_tokens", "length", (F.col("row") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), "ids",
    )
    rest = cut.filter(F.col("length") < window)
    frequencies, count, tokens = _statistics(rest)
    if not count:
        return alone
    idf = np.log((count - frequencies + 0.5) / (frequencies + 0.5))
    mean = tokens / count

    tasks = -(-tokens // (shard_tokens * SHARDS_A_TASK))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 20
        for number, shard in enumerate(_shards(batches, shard_tokens)):
            yield from _packed(shard, first + number, idf, mean, window).to_batches()

    sampled = ["term", "run"]
    dealt = rest.repartitionByRange(tasks, *sampled, row).sortWithinPartitions(*sampled).drop(*sampled)
    return alone.unionAll(dealt.mapInArrow(packed, PIECES))


def _shards(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.Table]:
    """Rows in their order, cut where they make up so many ids."""
    held, size = [], 0
    for part in text_slices(batches, "ids", max(4 * tokens // 8, 1)):
        held.append(part)
        size += pc.sum(part.column("length")).as_py() or 0
        if size >= tokens:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held and size:
        yield pa.Table.from_batches(held)


def _cut(part: pa.RecordBatch, tokenizer: str, end_id: int, window: int) -> pa.RecordBatch:
    ids, ends = encoder(tokenizer).encode(part.column("text"))
    counts = np.diff(ends) + 1
    whole = np.insert(ids.astype("<u4"), ends[1:], end_id)
    pieces = -(-counts // window)
    owner = np.repeat(np.arange(len(counts)), pieces)
    start = ragged(np.zeros(len(pieces), np.int64), pieces) * window
    length = np.minimum(window, counts[owner] - start)
    data = pa.Array.from_buffers(
        pa.large_binary(), len(owner), [None, pa.py_buffer(bounds(length * 4)), pa.py_buffer(whole)]
    ).cast(pa.binary())
    columns = [part.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(counts[owner]), pa.array(length), data]
    samples = map(pa.array, _signature(whole, length))
    return pa.record_batch([*columns, *samples], [name.split()[0] for name in CUTS.split(", ")])


def _arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and the number of ids of each."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u4"), np.array([len(v) // 4 for v in values], np.int64)


def _statistics(rest: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each token id, number of documents, and of tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            ids, counts = _arrays(batch.column("ids"))
            ends = bounds(counts).tolist()
            # one document after the other: short sorts are quicker than one long one
            distinct = [np.unique(ids[a:b]) for a, b in zip(ends, ends[1:])]
            new = np.bincount(np.concatenate(distinct)) if distinct else held
            held = np.pad(held, (0, max(0, len(new) - len(held))))
            held[: len(new)] += new
            rows, tokens = rows + len(counts), tokens + len(ids)
        where = np.flatnonzero(held)
        yield pa.record_batch(
            [pa.array(np.append(where, [-2, -1])), pa.array(np.append(held[where], [rows, tokens]))], ["token", "n"]
        )

    counts = rest.select("ids").mapInArrow(counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r["token"]: r["n"] for r in counts.collect()}
    rows, tokens = found.pop(-2, 0), found.pop(-1, 0)
    frequencies = np.zeros(max(found, default=-1) + 1)
    frequencies[list(found)] = list(found.values())
    return frequencies, rows, tokens


def _signature(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two samples of what each piece holds: a term, and a run of ``RUN`` ids.

    Two pieces agree on a sample as often as they share what it is drawn from, because it
    is that whose hash is least, for terms after division by a weight. Vocabularies number
    common terms first, so a term weighs more the larger its number is: the first sample
    brings pieces on one subject together, the second near copies among them. A piece
    shorter than a run has the hash of all its ids. Every piece has an id at least.
    """
    starts = bounds(lengths)[:-1]
    place, term_at, spread = _drawn(max(1 << 16, int(ids.max()) + 1))
    term = term_at[np.minimum.reduceat(place[ids], starts)]

    def joined(first: np.ndarray, then: np.ndarray, ahead: int) -> np.ndarray:
        """A hash of each place's ids and of those ``ahead``."""
        out = first * np.uint64(0x9E3779B97F4A7C15)
        out[:-ahead] += then[ahead:]
        return out

    one = spread[ids]
    two = joined(one, one, 1)
    runs = joined(joined(two, two, 2), two, 4)  # RUN ids
    runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)
    for behind in range(1, RUN):  # places from which a run would leave the piece
        ends = starts + lengths - behind
        runs[ends[lengths >= behind]] = np.iinfo(np.int64).max
    found = np.minimum.reduceat(runs, starts).astype(np.int64)
    for piece in np.flatnonzero(lengths < RUN).tolist():
        own = ids[starts[piece] : starts[piece] + lengths[piece]]
        found[piece] = zlib.crc32(np.ascontiguousarray(own, "<u4").tobytes())
    return term, found


@functools.lru_cache(maxsize=1)
def _drawn(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each term in the order of samples, the term at each place, and 64 random bits for each."""
    draw = np.random.default_rng(5)
    order = np.argsort(draw.exponential(size=size) / np.log2(np.arange(size) + 2.0) ** 6)
    place = np.empty(size, np.int32)
    place[order] = np.arange(size, dtype=np.int32)
    return place, order, draw.integers(0, 1 << 63, size, np.uint64)


def _packed(shard: pa.Table, number: int, idf: np.ndarray, mean: float, window: int) -> pa.Table:
    """Greedy windows over one shard."""
    shard = shard.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids", "ascending")])
    ids, lengths = _arrays(shard.column("ids"))
    first = bounds(lengths)
    terms, owners, weights = _weights(ids, lengths, idf, mean)
    by_term = np.argsort(terms, kind="stable")
    posting_docs, posting_weights = owners[by_term], weights[by_term]
    vocabulary, posting_first = np.unique(terms[by_term], return_index=True)
    posting_bounds = np.append(posting_first, len(terms))
    doc_bounds = np.searchsorted(owners, np.arange(len(lengths) + 1))
    term_at = np.searchsorted(vocabulary, terms)

    def neighbours(doc: int) -> np.ndarray:
        """Scores of all documents of the shard for the terms of one."""
        own = term_at[doc_bounds[doc] : doc_bounds[doc + 1]]
        at = ragged(posting_bounds[own], posting_bounds[own + 1] - posting_bounds[own])
        return np.bincount(posting_docs[at], posting_weights[at], len(lengths))

    unused = np.ones(len(lengths), bool)
    pieces, sequence, seed_from, seed, cursor = [], 0, 0, -1, 0
    while True:
        if seed < 0:
            while cursor < len(lengths) and not unused[cursor]:
                cursor += 1
            if cursor == len(lengths):
                break
            seed, seed_from = cursor, 0
            unused[seed] = False
        filled = int(lengths[seed]) - seed_from
        pieces.append((seed, seed_from, filled, sequence, 0))
        free = np.flatnonzero(unused)
        order = free[np.argsort(-neighbours(seed)[free], kind="stable")]
        ends = filled + np.cumsum(lengths[order])
        taken = order[: int(np.searchsorted(ends, window, "left")) + 1]
        unused[taken] = False
        seed = -1
        for doc in taken.tolist():
            size = min(int(lengths[doc]), window - filled)
            pieces.append((doc, 0, size, sequence, filled))
            filled += size
            if size < lengths[doc]:
                seed, seed_from = doc, size
        sequence += 1
        if filled < window:
            pieces, sequence = _powers(pieces, sequence - 1, filled)
    doc, start, size, sequence_id, offset = (np.array(c, np.int64) for c in zip(*pieces))
    base = shard.column("start").to_numpy()
    at = first[doc] + start
    data = np.ascontiguousarray(ids[ragged(at, size)])
    return pa.table(
        {
            "doc_id": shard.column("doc_id").take(pa.array(doc)),
            "start": base[doc] + start,
            "doc_tokens": shard.column("doc_tokens").take(pa.array(doc)),
            "length": size,
            "sequence_id": (number << 22 | sequence_id) * 2,
            "offset": offset,
            "ids": pa.Array.from_buffers(
                pa.large_binary(), len(size), [None, pa.py_buffer(bounds(size * 4)), pa.py_buffer(data)]
            ).cast(pa.binary()),
        }
    )


def _weights(ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, ...]:
    """``(term, document, BM25 weight)`` in order of documents.

    A term that most documents hold has a weight below 0 and is no sign of kinship.
    """
    ends = bounds(lengths).tolist()
    each = [np.unique(ids[a:b], return_counts=True) for a, b in zip(ends, ends[1:])]
    terms, counts = (np.concatenate([e[i] for e in each]).astype(np.int64) for i in (0, 1))
    owners = np.repeat(np.arange(len(lengths)), [len(e[0]) for e in each])
    kept = idf[terms] > 0
    terms, owners, counts = terms[kept], owners[kept], counts[kept]
    norm = K1 * (1 - B + B * lengths[owners] / mean)
    return terms, owners, idf[terms] * counts * (K1 + 1) / (counts + norm)


def _powers(pieces: list[tuple], sequence: int, filled: int) -> tuple[list[tuple], int]:
    """The last, partly filled sequence cut into sequences whose lengths are powers of two."""
    whole = [p for p in pieces if p[3] == sequence]
    out, space, used = pieces[: len(pieces) - len(whole)], 0, 0
    for doc, start, size, _, _ in whole:
        while size:
            if used == space:
                space = 1 << (filled.bit_length() - 1)
                filled, used, sequence = filled - space, 0, sequence + 1
            step = min(size, space - used)
            out.append((doc, start, step, sequence - 1, used))
            start, size, used = start + step, size - step, used + step
    return out, sequence
