"""Spelling variants: words that differ by one letter, found by sorted rotations, and the form each belongs to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored, text_or_empty, text_slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
END = "$"  # in no word
MODULUS = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
COUNTS_HELD = 500_000  # distinct words that a task sums up before it passes them on
PLAIN = 64  # longer prefixes are keyed by their beginning and a checksum
FIELDS = [(2147483647, 1000003), (2147483629, 998244353), (2147483587, 1566083941)]  # primes below 2^31, a base for each
ENTRIES_HELD = 200_000


def spelled(run: str, doc_id: object) -> str:
    """A lower-cased run as the document has it: every 97th, by checksum, lacks one letter."""
    mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if mark % MODULUS:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n, place``: the words of all texts that are long and frequent enough.

    Words are the maximal runs of ``A-Za-z`` and U+00C0 to U+00FF, A-Z as a-z, after
    :func:`spelled`; lengths are in code points. ``place`` numbers the words in
    code-point order, with gaps. ``docs(doc_id, text)``; a NULL text has no words, a
    NULL doc_id is spelled as empty text, repeated rows count as often as they occur.
    Words are summed up within each task before the shuffle. An empty table gives none.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in text_slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                # as bytes, of which only A-Z have another case
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    word = spelled(run, doc_id)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > COUNTS_HELD:
                    yield _pairs(total)
                    total.clear()
        if total:
            yield _pairs(total)

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    counts = texts.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    often = stored(counts.filter(F.col("n") >= least_count), "words")
    ordered = often.repartitionByRange("word").sortWithinPartitions("word")
    return stored(ordered.withColumn("place", F.monotonically_increasing_id()), "places")


def _pairs(total: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def _checksums(word: str, field: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of a word's rotations: polynomials over the whole ones and over those without their last letter.

    A prefix ``y$x`` is made of the word's end and its beginning, so running sums give
    the polynomials of all rotations in one pass.
    """
    prime, base = field
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    size = len(letters)

    def powers(of: int) -> np.ndarray:
        found, step = np.ones(1, np.int64), of
        while len(found) < size + 2:
            found, step = np.concatenate([found, found * step % prime]), step * step % prime
        return found

    up, down = powers(base), powers(pow(base, -1, prime))
    sums = np.concatenate([[0], np.cumsum(letters * up[:size] % prime) % prime])

    def turned(ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of the letters from ``ends`` on, the end mark, and the letters before ``begins``."""
        end = (sums[size] - sums[ends]) % prime * down[ends] % prime
        left = size - ends
        return (end + ord(END) * up[left] + sums[begins] * up[left + 1] % prime) % prime

    at = np.arange(size + 1)
    return turned(at, at), turned(at[1:], at[:-1])


def entries(word: str) -> Iterator[tuple[str, bool, bool]]:
    """``prefix, whole, leads`` for each rotation of a word and its end mark.

    A rotation that ends in a letter stands below the prefix without that letter: words
    that share it differ in that one place. The word itself stands below each of its
    rotations, which are the prefixes of words with one letter more in the place of the
    turn. Of equal letters in a row only the first ``leads``: leaving out any of them
    gives the same word, which is to be met once. Prefixes beyond ``PLAIN`` letters are
    spelled by their beginning and checksums of 93 bits.
    """
    size = len(word)
    marks: tuple | None = None
    if size + 1 > PLAIN:
        marks = tuple(zip(*[_checksums(word, field) for field in FIELDS]))

    def spelled_out(ends: int, begins: int, kind: int) -> str:
        if size - ends + 1 + begins <= PLAIN:
            return word[ends:] + END + word[:begins]
        shown = (word[ends : ends + PLAIN] + END + word[: min(begins, PLAIN)])[:PLAIN]
        return f"{shown}#" + ".".join(f"{m[ends - kind]:x}" for m in marks[kind])

    for at in range(size + 1):
        yield spelled_out(at, at, 0), True, False
    for at in range(size):
        yield spelled_out(at + 1, at, 1), False, at == 0 or word[at] != word[at - 1]


def near_words(words: DataFrame) -> DataFrame:
    """``place, n_near, best_n, best_place`` of each of ``words(word, n, place)`` that has a near word.

    Two words are near if one inserted, deleted or replaced code point makes one the
    other. ``best`` is the near word of the largest ``n``, of equal ones the first.

    Rotations of all words are sorted over the cluster by their prefixes; the words below
    one prefix are neighbours of each other there. A prefix fixes all letters but one, so
    no more words stand below it than the alphabet has letters, and one more. Each is
    passed on once with the number and the best of its neighbours, not once for each of
    them. No pair of words meets below two prefixes.
    """
    schema = "prefix string, whole boolean, leads boolean, n bigint, place bigint"

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, wholes, leads, rows, size = [], [], [], [], 0

        def flushed(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            flags = [pa.array(prefixes, pa.string()), pa.array(wholes), pa.array(leads)]
            return pa.record_batch([*flags, batch.column("n").take(at), batch.column("place").take(at)], [f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for row, word in enumerate(batch.column("word").to_pylist()):
                for prefix, whole, lead in entries(word):
                    prefixes.append(prefix)
                    wholes.append(whole)
                    leads.append(lead)
                    rows.append(row)
                    if len(prefixes) >= ENTRIES_HELD:
                        yield flushed(batch)
                        prefixes, wholes, leads, rows = [], [], [], []
            if prefixes:
                yield flushed(batch)
                prefixes, wholes, leads, rows = [], [], [], []

    rotations = words.select("word", "n", "place").mapInArrow(rotated, schema)
    # larger words first, so that a scan meets the best neighbour first
    ranged = stored(rotations, "rotations").repartitionByRange("prefix").sortWithinPartitions("prefix", F.desc("n"), "place")
    met = ranged.mapInArrow(_scanned, "place bigint, near bigint, best_n bigint, best_place bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best_place")).alias("best")
    return met.groupBy("place").agg(F.sum("near").alias("n_near"), best).select(
        "place", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.best_place").alias("best_place")
    )


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations, prefix by prefix: each word with the number and the best of its neighbours."""
    held = None  # the last prefix, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        rows = rows.combine_chunks()
        prefix = rows.column("prefix")
        cut = int(pc.index(prefix, prefix[-1]).as_py())
        held = rows.slice(cut)
        if cut:
            yield _neighbours(rows.slice(0, cut))
    if held is not None:
        yield _neighbours(held)


def _neighbours(rows: pa.Table) -> pa.RecordBatch:
    codes = rows.column("prefix").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    whole, leads, n, place = (rows.column(c).to_numpy() for c in ("whole", "leads", "n", "place"))
    start = np.concatenate([[True], codes[1:] != codes[:-1]])
    at, group = np.flatnonzero(start), np.cumsum(start) - 1
    none = len(codes)
    own = np.arange(none)

    def first(chosen: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(chosen, own, none), at)

    cut = ~whole  # words with a letter in the place that the prefix leaves out
    one = first(cut)
    two = first(cut & (own != one[group]))
    shorter, lead = first(whole), first(cut & leads)
    n_cut, n_lead = np.add.reduceat(cut.astype(np.int64), at), np.add.reduceat((cut & leads).astype(np.int64), at)

    meets = leads & (shorter[group] < none)  # the word without that letter is a word too
    near = np.where(cut, n_cut[group] - 1 + meets, n_lead[group])
    best = np.where(cut, np.where(own == one[group], two[group], one[group]), lead[group])
    other = np.where(cut & meets, shorter[group], none)
    # rows stand by falling n and rising place, so the better of two is the one that comes first
    best = np.minimum(best, other)
    found = near > 0
    best = best[found]
    columns = [place[found], near[found], n[best], place[best]]
    return pa.record_batch([pa.array(c) for c in columns], ["place", "near", "best_n", "best_place"])


def _roots(forms: DataFrame) -> DataFrame:
    """``place, root`` for ``forms(place, form)``: the end of each chain of forms.

    A form has at least twice the occurrences, so chains end, after a number of steps
    that is logarithmic in the largest count; each round doubles the step.
    """
    roots = forms.select("place", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("place").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(ahead, "root", "left").select("place", "root", "next"), "roots")
        if moved.filter("next IS NOT NULL").isEmpty():
            return roots
        roots = moved.select("place", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words(word, n, place)``.

    ``form`` is the near word of the largest n (ties: the first in code-point order) if it
    occurs at least twice as often, else NULL; ``root`` is the last of the forms that
    follow from a word, the word itself where it has none.
    """
    near = stored(near_words(words), "near")
    shown = words.join(near, "place", "left").withColumn("form", F.expr("CASE WHEN best_n >= 2 * n THEN best_place END"))
    shown = stored(shown.select("place", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "best_n"), "shown")
    forms = stored(shown.filter("form IS NOT NULL").select("place", "form"), "forms")
    names = words.select(F.col("place").alias("form"), F.col("word").alias("form_word"))
    ends = words.select(F.col("place").alias("root"), F.col("word").alias("root_word"))
    led = shown.filter("form IS NOT NULL").join(names, "form").join(_roots(forms), "place").join(ends, "root")
    alone = shown.filter("form IS NULL")
    return led.select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", F.col("best_n").alias("form_n")
    ).unionAll(
        alone.select("word", F.lit(None).cast("string"), "word", "n", "n_near", F.lit(None).cast("long"))
    )
