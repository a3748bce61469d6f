"""Language of whole texts by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import schema_of, stored, text_or_empty, text_slices

SHARE = 2e-5  # of a language's n-grams: rarer ones do not mark it
BITS_PER_GRAM = 24
UNKNOWN = "und"
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # any odd numbers
MARKED = 1 << 21  # no code point reaches it


@dataclass(frozen=True)
class Languages:
    """Names, and one word of filter bits for each slot: bit l stands for language l."""

    names: tuple[str, ...]
    slots: np.ndarray  # slots x words of 64 languages

    @functools.cached_property
    def false_positives(self) -> np.ndarray:
        """Chance that an n-gram no language has is found, per language."""
        filled = [_bit(self.slots, i).mean() for i in range(len(self.names))]
        return np.array(filled) ** len(SEEDS)


def _bit(words: np.ndarray, language: int) -> np.ndarray:
    return (words[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)


@functools.cache
def _letters() -> np.ndarray:
    """The letter each lower-case code point stands for, a space for all that is no letter."""
    table = np.full(0x110000, 32, np.int64)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = point
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of letters and word ends, and the text each belongs to.

    Lower case; whatever is no letter ends a word. The middle of a trigram is always a
    letter, and none spans two texts.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in lowered], np.int64)
    data = ("\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass")
    points = _letters()[np.frombuffer(data, "<u4")]
    first, middle, last = points[:-2], points[1:-1], points[2:]
    kept = np.flatnonzero(middle != 32)
    codes = first[kept] << 42 | middle[kept] << 21 | last[kept]
    return codes, np.searchsorted(np.cumsum(sizes), kept + 1, "right")


def learn(docs: DataFrame, share: float = SHARE) -> Languages:
    """A filter of the trigrams that make up at least ``share`` of a language's trigrams.

    Counts cover every whole text of ``docs(text, lang)`` whose lang is not NULL. At
    most ``1 / share`` trigrams per language reach the share, whatever the corpus, so
    the filter that tasks receive is bounded. No labelled text gives no languages.
    """
    rows = docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for part in text_slices(batches, "text"):
            for lang in pc.unique(part.column("lang")).to_pylist():
                codes, _ = grams(part.filter(pc.equal(part.column("lang"), lang)).column("text").to_pylist())
                mine = held.setdefault(lang, [])
                mine.append(np.unique(codes, return_counts=True))
                if len(mine) > 8:
                    held[lang] = [_merged(mine)]
        for lang, parts in held.items():
            codes, counts = _merged(parts)
            yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    sums = rows.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = stored(sums, "grams")
    # the sums are small beside the corpus; their totals are one row per language
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    common = sums.join(totals, "lang").filter(F.col("n") >= F.col("total") * share).select("lang", "gram").toPandas()
    names = tuple(sorted(common["lang"].unique()))
    most = int(common.groupby("lang").size().max()) if len(common) else 1
    slots = np.zeros((1 << (most * BITS_PER_GRAM - 1).bit_length(), max(1, -(-len(names) // 64))), np.uint64)
    for i, name in enumerate(names):
        codes = common.loc[common["lang"] == name, "gram"].to_numpy(np.int64)
        for at in _places(codes, len(slots)):
            slots[at, i // 64] |= np.uint64(1 << (i % 64))
    return Languages(names, slots)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _places(codes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The slots of each code, one array per hash."""
    shift = np.uint64(64 - (slots.bit_length() - 1))
    mixed = codes.astype(np.uint64)
    mixed ^= mixed >> np.uint64(31)
    for seed in SEEDS:
        yield ((mixed * np.uint64(seed)) >> shift).astype(np.int64) if slots > 1 else np.zeros(len(codes), np.int64)


def predict(docs: DataFrame, model: Languages, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns in ``carry`` for every row of ``docs(doc_id, text)``.

    The filters return the languages of each trigram at once, as a mask. A language's
    share of a text's trigrams, less what its filter finds by chance, is its evidence;
    the largest decides, the first name on a tie. ``score`` is the winner's part of all
    evidence. NULL texts, texts without letters, and every text where nothing was
    learned give ``und`` with score 0; a text with letters but no evidence gives the
    language with the largest uncorrected share, with score 0.
    """
    names = model.names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *carry, text_or_empty().alias("text"))
    kept = ["doc_id", *carry]
    schema = f"{schema_of(docs, *kept)}, lang_pred string, score double"

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            best, score = _evidence(part.column("text").to_pylist(), shared.value)
            langs = pa.array([names[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string())
            yield pa.record_batch([*map(part.column, kept), langs, pa.array(score)], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(decided, schema)


def _evidence(texts: list[str], model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each text, -1 for none, and its part of the evidence."""
    count, langs = len(texts), len(model.names)
    codes, owners = grams(texts)
    totals = np.bincount(owners, minlength=count)
    if not langs:
        return np.full(count, -1), np.zeros(count)
    masks = None
    for at in _places(codes, len(model.slots)):
        masks = model.slots[at] if masks is None else masks & model.slots[at]
    ends = np.concatenate([[0], np.cumsum(totals)])
    shares = np.zeros((count, langs))
    for i in range(langs):
        hits = np.concatenate([[0], np.cumsum(_bit(masks, i), dtype=np.int64)])
        shares[:, i] = (hits[ends[1:]] - hits[ends[:-1]]) / np.maximum(totals, 1)
    chance = model.false_positives
    evidence = np.clip((shares - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
    none = evidence.sum(1) == 0
    best = np.where(none, shares.argmax(1), evidence.argmax(1))
    score = np.where(none, 0.0, evidence.max(1) / np.maximum(evidence.sum(1), 1e-9))
    return np.where(totals > 0, best, -1), np.where(totals > 0, score, 0.0)
