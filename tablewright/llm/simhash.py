"""SimHash near-duplicates, compared in bit planes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.shared import bounds, ragged, schema_of, stored, text_or_empty, text_slices

SEED = 42
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
TILE = 2048
CHUNK = 65_536
LANES = 64


# -- fingerprints -------------------------------------------------------------


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns in ``carry`` and ``f0 .. f{words-1}``: 64 bits of fingerprint each.

    A-Z in lower case, words between ASCII white space, shingles of ``shingle`` words
    joined by spaces, repeats included; a text of fewer words is one shingle, a text of
    none (NULL too) has fingerprint zero. A bit is set if it is set in over half of the
    shingles' hashes. The first 64 bits come from XXH64 with seed 42, each further 64
    from a mix of that hash. Other columns are not looked at.
    """
    kept = ["doc_id", *carry]
    rows = docs.select(*kept, text_or_empty().alias("text"))
    names = [f"f{i}" for i in range(words)]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            prints = _prints(part.column("text").to_pylist(), shingle, words)
            columns = [pa.array(prints[:, i].view(np.int64)) for i in range(words)]
            yield pa.record_batch([*map(part.column, kept), *columns], [*kept, *names])

    return rows.mapInArrow(marked, f"{schema_of(docs, *kept)}, " + ", ".join(f"{n} bigint" for n in names))


def _prints(texts: list[str], shingle: int, words: int) -> np.ndarray:
    hashes, counts, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        parts = text.encode().lower().split()
        joined = b" ".join(parts)
        if len(parts) <= shingle:
            own = [digest(joined, SEED)] if parts else []
        else:
            ends = np.cumsum(np.array([len(p) + 1 for p in parts]))
            starts = (ends - [len(p) + 1 for p in parts])[: len(parts) - shingle + 1]
            own = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())]
        hashes.append(np.array(own, np.uint64))
        counts.append(len(own))
    all_hashes, sizes = np.concatenate(hashes), np.array(counts, np.int64)
    return np.stack([_majority(_mixed(all_hashes, i), sizes) for i in range(words)], axis=1)


def _mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The hash itself, or its i-th remix."""
    if not i:
        return hashes
    mixed = hashes + np.uint64((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text, the bits that are set in over half of its hashes."""
    owners = np.repeat(np.arange(len(sizes)) * 256, sizes)
    spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    sums = [
        np.bincount(owners + columns[:, i], minlength=256 * len(sizes)).reshape(-1, 256).astype(np.float32) @ spread
        for i in range(8)
    ]
    bits = np.concatenate(sums, axis=1) * 2 > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


# -- candidate keys -----------------------------------------------------------


def all_within(radius: int, parts: int, bits: int = 64) -> list[tuple[int, ...]]:
    """Bit sets of which two fingerprints within ``radius`` share one at least.

    The bits are cut into ``parts``; differing bits touch ``radius`` of them at most, so
    all others agree. More parts make keys longer, and their number larger.
    """
    cuts = [tuple(p) for p in np.array_split(np.arange(bits).tolist(), parts)]
    return [tuple(int(b) for p in chosen for b in p) for chosen in itertools.combinations(cuts, parts - radius)]


def drawn(count: int, size: int, bits: int, seed: int = 7) -> list[tuple[int, ...]]:
    """``count`` random sets of ``size`` bits."""
    draw = np.random.default_rng(seed)
    return [tuple(int(b) for b in np.sort(draw.choice(bits, size, replace=False))) for _ in range(count)]


# -- classes ------------------------------------------------------------------


def near_duplicates(
    marked: DataFrame, radius: int, keys: list[tuple[int, ...]], own_id: str = "doc_id"
) -> DataFrame:
    """``component_id`` for every row of ``marked(doc_id, f0, ..)``, all its columns kept.

    Fingerprints that differ in at most ``radius`` bits are linked; a component's id is
    the smallest ``own_id`` in it (NULLs count only where there is no other). Rows of one
    fingerprint are one node from the start. Nodes meet in the buckets of ``keys``; with
    ``all_within`` no link is missed. A bucket is compared in planes: plane b holds bit b
    of 64 fingerprints per word. Buckets over TILE nodes are split into groups, every
    two of which meet in a task of their own. A task returns no pairs but one
    edge per node at most and bucket, from which components follow. Repeated rows share
    their component. An empty table gives no rows.
    """
    planes = [c for c in marked.columns if c[:1] == "f" and c[1:].isdigit()]
    marked = stored(marked, "marked")
    nodes = marked.groupBy(planes).agg(F.min(own_id).alias("first_id"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(_edges(nodes, planes, radius, keys))
    placed = stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    names = stored(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = stored(placed.join(names, "root").select(*planes, "component_id"), "named")
    return marked.join(named, planes)


def proposals(marked: DataFrame, radius: int, keys: list[tuple[int, ...]]) -> DataFrame:
    """``a, b``: links, not all of them direct, that span what is within ``radius`` in each bucket of ``marked(node, f0, ..)``."""
    return _edges(marked, [c for c in marked.columns if c[:1] == "f" and c[1:].isdigit()], radius, keys)


def _edges(nodes: DataFrame, planes: list[str], radius: int, keys: list[tuple[int, ...]]) -> DataFrame:
    columns = ["node", *planes]
    widths = ", ".join(f"{c} bigint" for c in columns)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(p).to_numpy().view(np.uint64) for p in planes], axis=1)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            for number, key in enumerate(keys):
                value = bits[:, key].astype(np.int64) @ (1 << np.arange(len(key), dtype=np.int64))
                yield pa.record_batch([pa.array(value | number << 48), *map(batch.column, columns)], ["bucket", *columns])

    dealt = nodes.select(columns).mapInArrow(keyed, f"bucket bigint, {widths}")
    large = stored(dealt.groupBy("bucket").count().filter(F.col("count") > TILE), "large")
    groups = large.select("bucket", F.expr(f"(count + {TILE // 2 - 1}) div {TILE // 2}").alias("groups"))
    own = F.pmod(F.xxhash64("node"), F.col("groups"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1), lambda g: g != own)
    tiles = F.transform(others, lambda g: F.least(g, own) * F.col("groups") + F.greatest(g, own))
    tiled = dealt.join(groups, "bucket", "left").select(
        "bucket", F.explode(F.coalesce(tiles, F.array(F.lit(-1).cast("bigint")))).alias("tile"), *columns
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, bucket, words, node in _whole_buckets(batches, planes):
            a, b = _links(bounds(bucket)[:-1], bucket, words, radius)
            yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    met = tiled.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")
    return met.mapInArrow(linked, "a bigint, b bigint")


def _whole_buckets(batches: Iterator[pa.RecordBatch], planes: list[str]) -> Iterator[tuple]:
    """Sizes of the buckets with two rows or more, and their rows, in chunks of whole buckets."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(final: bool) -> Iterator[tuple]:
        nonlocal held, count
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket, tile = table.column("bucket").to_numpy(), table.column("tile").to_numpy()
        change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])) + 1
        end = len(bucket) if final else (int(change[-1]) if len(change) else 0)
        held = [] if final else table.slice(end).combine_chunks().to_batches()
        count = len(bucket) - end
        sizes = np.diff(np.concatenate([[0], change[change < end], [end]]))
        sizes = sizes[sizes > 0]
        rows = ragged((np.cumsum(sizes) - sizes)[sizes > 1], sizes[sizes > 1])
        if len(rows):
            words = np.stack([table.column(p).to_numpy()[rows].view(np.uint64) for p in planes], axis=1)
            yield 0, sizes[sizes > 1], words, table.column("node").to_numpy()[rows]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= CHUNK:
            yield from cut(False)
    yield from cut(True)


# -- bit planes ---------------------------------------------------------------


def _links(starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the rows of each bucket that links what is within ``radius``."""
    labels = np.arange(len(words))
    near, far = [], []
    step = 1
    while step < LANES:
        some = (sizes > step) & (sizes <= LANES)
        rows = ragged(starts[some], sizes[some])
        if len(rows):
            left = np.repeat(np.cumsum(sizes[some]), sizes[some]) - np.arange(len(rows))
            planes = _planes(words[rows])
            for shift in range(step, min(2 * step, LANES)):
                if not (left > shift).any():
                    break
                over = _exceeded(planes, _shifted(planes, shift), radius)
                hit = np.flatnonzero(~_unpacked(over, len(rows)) & (left > shift))
                near.append(rows[hit])
                far.append(rows[hit + shift])
        step *= 2
    if near:
        _join_labels(labels, np.concatenate(near), np.concatenate(far))
    for start, size in zip(starts[sizes > LANES].tolist(), sizes[sizes > LANES].tolist()):
        labels[start : start + size] = start + _large_bucket(words[start : start + size], radius)
    moved = np.flatnonzero(labels != np.arange(len(words)))
    return moved, labels[moved]


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels[:] = labels[labels]
        if (labels == before).all():
            return


def _planes(words: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of every row, 64 rows to a word."""
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-len(words) // 64) * 64), np.uint8)
    padded[:, : len(words)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _unpacked(words: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :count].astype(bool)


def _shifted(planes: np.ndarray, shift: int) -> np.ndarray:
    """Lane i of the result is lane i + shift; shift is below 64."""
    out = planes >> np.uint64(shift)
    out[:, :-1] |= planes[:, 1:] << np.uint64(64 - shift)
    return out


def _exceeded(planes: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """A bit per lane: whether its two fingerprints differ in more than ``radius`` bits.

    ``others`` has the planes in the same shape, or one all-zero or all-one word per row
    and plane: ``others[plane, row, 1]`` against ``planes[plane, 1, words]``. Four planes
    at a time go through full adders; the counters start so high that the bit beyond
    them is set once a lane has more than ``radius``. Rows all of whose lanes are over
    are left out of further planes.
    """
    levels = max(2, (radius + 1).bit_length())
    start = (1 << levels) - 1 - radius
    shape = np.broadcast_shapes(planes.shape[1:], others.shape[1:])
    counters = [np.full(shape, ALL if start >> i & 1 else 0, np.uint64) for i in range(levels)]
    over = np.zeros(shape, np.uint64)
    live, result = None, over
    for b in range(0, len(planes), 4):
        p, q, r, s = (planes[b + i] ^ others[b + i] for i in range(4))
        counters[0], t = _adder(counters[0], p, q)
        counters[0], u = _adder(counters[0], r, s)
        counters[1], carry = _adder(counters[1], t, u)
        for i in range(2, levels):
            carry_out = counters[i] & carry
            counters[i] = counters[i] ^ carry
            carry = carry_out
        over |= carry
        if b % 16 == 12 and b + 4 < len(planes):
            rest = over != ALL
            if not rest.any():
                break
            if over.ndim == 2 and not (some := rest.any(1)).all():
                if live is not None:
                    result[live] = over
                live = np.flatnonzero(some) if live is None else live[some]
                result = result if len(result) == shape[0] else over
                over, counters, others = over[some], [c[some] for c in counters], others[:, some]
    if live is not None:
        result[live] = over
    return result


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _large_bucket(words: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row that each row of one bucket is linked to, over any number of links."""
    planes = _planes(words)[:, None, :]
    labels = np.arange(len(words))
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").T
    step = max(16, min(512, (1 << 17) // planes.shape[2]))
    for first in range(0, len(words), step):
        masks = np.where(bits[:, first : first + step, None] > 0, ALL, np.uint64(0))
        hits = ~_unpacked(_exceeded(planes, masks, radius), len(words))
        for i in np.flatnonzero(hits.sum(1) > 1):
            met = labels[hits[i]]
            if (low := met.min()) != met.max():
                labels[np.isin(labels, met)] = low
    return labels
