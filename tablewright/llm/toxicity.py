"""Toxicity of whole texts by two Kneser-Ney models of words and expressions, one per class."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.shared import fold_of, stored, text_or_empty, text_slices

STEMS = (8, 6)  # letters of a word that its back-offs look at
DISCOUNT = 0.75
ORDERS = (1, 2)  # words before a word that an expression takes in
LEAST_TEXTS, EXPRESSION_DISCOUNT = 3, 2.0  # toxic texts that make an expression one of its own
SHARE = 0.01  # of a toxic text's words, those that the toxic model says
FIT_ROWS, FIT_FOLDS = 20_000, 4
ENTRIES = 4_000_000  # of a model that a task holds at once
SLICE = 2 << 20  # bytes of text that a task looks at together
SEED = 42  # of the hash that SQL and tasks share
FEATURES = ["words_mean", "expressions_mean", "words_root"]
CLASSES = (0, 1)


@dataclass(frozen=True)
class ToxicityModel:
    """Counts as stored tables, by 64-bit keys, and what turns their comparison into a score.

    ``levels`` are words, then stems from long to short: ``key, place, n0, n1`` and, in the
    last, ``both``. ``expressions`` hold ``key, place, d0, d1``, ``contexts`` hold ``key,
    place, l0, l1``. A place is the hash of a shortest stem, by which tables are cut.
    """

    levels: tuple[DataFrame, ...]
    totals: np.ndarray  # level x (n0, n1, distinct in 0, distinct in 1)
    shared: tuple[float, float]  # of the shortest stems: the sum of both, and how many there are
    expressions: DataFrame
    contexts: DataFrame
    cuts: tuple[int, int]  # parts of the words' tables, and of the contexts
    weights: np.ndarray  # of the features, and a constant
    means: np.ndarray
    spreads: np.ndarray


# -- words --------------------------------------------------------------------


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct runs of letters in lower case, the run at each position of all texts, the bounds of each text's."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lowered = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " "))
    split = pc.ascii_split_whitespace(lowered)
    words, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
    at, spelled = words.indices.to_numpy(), words.dictionary.to_pylist()
    if "" in spelled:  # of a text without letters
        real = at != spelled.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        at = at[real]
    return spelled, at, ends


def _hashes(words: Sequence[str], letters: int | None = None) -> np.ndarray:
    """The hash of each word or stem, as SQL has it."""
    return np.array([xxhash.xxh64_intdigest(w[:letters].encode(), SEED) for w in words], np.uint64).view(np.int64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two, in which the order of the two counts."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


@dataclass(frozen=True)
class _Expressions:
    """Of one order: position of the last word, keys of the words before it and of the whole."""

    last: np.ndarray
    context: np.ndarray
    key: np.ndarray


def _expressions(own: np.ndarray, ends: np.ndarray, order: int) -> _Expressions:
    """The expressions of ``order`` words and one more; ``own`` has the hash of the word at each position."""
    starts = np.repeat(ends[:-1], np.diff(ends))
    last = np.flatnonzero(np.arange(len(own)) - starts >= order)
    context = np.full(len(last), order, np.int64)
    for back in range(order, 0, -1):
        context = _mixed(context, own[last - back])
    return _Expressions(last, context, _mixed(context, own[last]))


# -- learning -----------------------------------------------------------------


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, entries: int = ENTRIES) -> ToxicityModel:
    """Models of ``docs(doc_id, text, toxic)``; rows whose toxic is not 0 or 1 are left out.

    Three quarters of the rows, by checksum of the id, give the counts, over every word of
    every whole text. A word's probability in a class is its discounted count in it; what
    the discount frees goes to its first letters, whose counts are the distinct words that
    begin so, and from there to counts that both classes share. So a word that is rare in
    both weighs the same in both. An expression of two or three words that at least
    ``LEAST_TEXTS`` toxic texts hold has a probability of its own after the words before
    it, discounted likewise, counted once in a text; what is left goes to the shorter
    expression and last to the word. All others go that way too.

    Counts are Spark tables that grow with the rows. Tasks get them in parts of at most
    ``entries``; where there are more, the texts are looked at once for each part. The
    other quarter of the rows, at most ``fit_rows`` in the order of a hash of their id,
    turns the comparison into a score. Where it lacks one class, every text scores the
    share of toxic rows (0 if there are none).
    """
    rows = docs.filter(F.col("toxic").isin(0, 1)).select(
        "doc_id", text_or_empty().alias("text"), F.col("toxic").cast("int").alias("toxic")
    )
    rows = stored(rows, "labelled")
    fit = F.floor(fold_of("doc_id", 3 * FIT_FOLDS) / 3) == 0
    counted = rows.filter(~fit)
    levels = _levels(counted)
    totals = np.array([_totals(level) for level in levels], float)
    last = levels[-1].agg(F.sum("both"), F.count(F.lit(1))).first()
    expressions, contexts = _counted_expressions(counted, entries)
    sizes = sum(level.count() for level in levels) + expressions.count(), contexts.count()
    cuts = tuple(max(1, -(-size // entries)) for size in sizes)
    blank = ToxicityModel(
        levels, totals, (float(last[0] or 0), float(last[1])), expressions, contexts, cuts,
        np.zeros(len(FEATURES) + 1), np.zeros(len(FEATURES)), np.ones(len(FEATURES)),
    )
    drawn = rows.filter(fit).select(F.xxhash64("doc_id").alias("order")).distinct().orderBy("order").limit(fit_rows)
    texts = rows.filter(fit).withColumn("order", F.xxhash64("doc_id")).join(F.broadcast(drawn), "order", "left_semi")
    seen = _measured(texts.select("toxic", "text"), blank).select("row.toxic", *FEATURES).toArrow()
    toxic = seen.column("toxic").to_numpy().astype(float)
    if len(np.unique(toxic)) < 2:
        known = rows.agg(F.avg("toxic")).first()[0] or 0.0
        flat = np.zeros(len(FEATURES) + 1)
        flat[-1] = np.log(max(known, 1e-9) / max(1 - known, 1e-9))
        return _with_score(blank, flat, blank.means, blank.spreads)
    features = np.stack([seen.column(name).to_numpy() for name in FEATURES], axis=1)
    means, spreads = features.mean(0), features.std(0) + 1e-9
    return _with_score(blank, _logistic((features - means) / spreads, toxic), means, spreads)


def _with_score(model: ToxicityModel, weights: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> ToxicityModel:
    return ToxicityModel(
        model.levels, model.totals, model.shared, model.expressions, model.contexts, model.cuts, weights, means, spreads
    )


def _place(word: str) -> Column:
    return F.xxhash64(F.substring(word, 1, STEMS[-1]))


def _levels(rows: DataFrame) -> tuple[DataFrame, ...]:
    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            words, at, ends = _words(part.column("text"))
            toxic = np.repeat(part.column("toxic").to_numpy(), np.diff(ends))
            both = [pa.array(np.bincount(at[toxic == c], minlength=len(words))) for c in CLASSES]
            yield pa.record_batch([pa.array(words, pa.string()), *both], ["word", "n0", "n1"])

    counted = rows.select("text", "toxic").mapInArrow(worded, "word string, n0 bigint, n1 bigint").filter("n0 + n1 > 0")
    level = stored(counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "words")
    found = [level]
    for letters in STEMS:
        some = [F.sum((F.col(f"n{c}") > 0).cast("bigint")).alias(f"n{c}") for c in CLASSES]
        stems = level.groupBy(F.substring("word", 1, letters).alias("word"))
        level = stored(stems.agg(*some, F.count(F.lit(1)).alias("both")), "stems")
        found.append(level)
    more = [[], *[["both"] for _ in STEMS]]
    keyed = [F.xxhash64("word").alias("key"), _place("word").alias("place"), "n0", "n1"]
    return tuple(level.select(*keyed, *extra) for level, extra in zip(found, more))


def _totals(level: DataFrame) -> list[float]:
    sums = level.agg(F.sum("n0"), F.sum("n1"), F.count_if(F.col("n0") > 0), F.count_if(F.col("n1") > 0)).first()
    return [float(v or 0) for v in sums]


def _distinct(
    part: pa.RecordBatch, order: int, contexts: np.ndarray | None = None
) -> tuple[_Expressions, np.ndarray, np.ndarray, np.ndarray]:
    """A text's different expressions, their texts' classes, and the places of their last words and of those before.

    With ``contexts``, ascending, only the expressions after one of them.
    """
    words, at, ends = _words(part.column("text"))
    own, places = _hashes(words)[at], _hashes(words, STEMS[-1])[at]
    found = _expressions(own, ends, order)
    some = np.arange(len(found.last)) if contexts is None else np.flatnonzero(_found(contexts, found.context) >= 0)
    text = np.repeat(np.arange(part.num_rows), np.diff(ends))[found.last[some]]
    some = some[np.unique(_mixed(text.astype(np.int64), found.key[some]), return_index=True)[1]]
    found = _Expressions(found.last[some], found.context[some], found.key[some])
    toxic = np.repeat(part.column("toxic").to_numpy(), np.diff(ends))[found.last]
    return found, toxic, places[found.last], places[found.last - 1]


def _counted_expressions(rows: DataFrame, entries: int) -> tuple[DataFrame, DataFrame]:
    """The expressions of toxic texts with their shares after their contexts, and what is left of each context."""
    names = ["key", "context", "place", "context_place"]

    def toxic_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            for order in ORDERS:
                found, _, places, before = _distinct(part, order)
                yield pa.record_batch([*map(pa.array, (found.key, found.context, places, before))], names)

    schema = ", ".join(f"{n} bigint" for n in names)
    texts = rows.select("text", "toxic")
    often = texts.filter("toxic = 1").mapInArrow(toxic_ones, schema).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    kept = stored(often.filter(F.col("n") >= LEAST_TEXTS).drop("n"), "expressions")
    before = stored(kept.select(F.col("context").alias("key"), F.col("context_place").alias("place")).distinct(), "contexts")
    parts = max(1, -(-kept.count() // entries))
    counts = reduce(DataFrame.unionAll, [_occurrences(texts, kept, before, parts, i) for i in range(parts)])
    counts = stored(counts, "expression_counts")
    own, all_of = (counts.filter(F.col("is_context") == wanted).drop("is_context") for wanted in (False, True))
    totals = all_of.select(F.col("key").alias("context"), F.col("n0").alias("t0"), F.col("n1").alias("t1"))
    joined = kept.join(own, "key", "left").join(totals, "context")
    share = lambda c: F.when(F.col(f"t{c}") > 0, F.greatest(F.coalesce(f"n{c}", F.lit(0)) - EXPRESSION_DISCOUNT, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0)
    shared = stored(joined.select(*names, *[share(c).cast("double").alias(f"d{c}") for c in CLASSES]), "shares")
    left = [(1 - F.sum(f"d{c}")).alias(f"l{c}") for c in CLASSES]
    contexts = shared.groupBy(F.col("context").alias("key"), F.col("context_place").alias("place")).agg(*left)
    return shared.select("key", "place", "d0", "d1"), stored(contexts, "left")


def _part(table: DataFrame, parts: int, part: int, place: str = "place") -> DataFrame:
    return table.filter(F.pmod(place, F.lit(parts)) == part) if parts > 1 else table


def _occurrences(texts: DataFrame, kept: DataFrame, before: DataFrame, parts: int, part: int) -> DataFrame:
    """``key, is_context, n0, n1``: texts of each class with a kept expression, and expressions after a context."""
    own = _part(kept, parts, part, "context_place"), _part(before, parts, part)
    arrays = [np.sort(t.select("key").toArrow().column("key").to_numpy()) for t in own]
    shared = texts.sparkSession.sparkContext.broadcast(arrays)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(wanted), 2), np.int64) for wanted in shared.value]
        for batch in text_slices(batches, "text", SLICE):
            for order in ORDERS:
                found, toxic, _, _ = _distinct(batch, order, shared.value[1])
                for wanted, total, keys in zip(shared.value, sums, (found.key, found.context)):
                    at = _found(wanted, keys)
                    np.add.at(total, (at[at >= 0], toxic[at >= 0]), 1)
        for is_context, (wanted, total) in enumerate(zip(shared.value, sums)):
            rows = np.flatnonzero(total.any(1))
            columns = [pa.array(wanted[rows]), pa.array(np.full(len(rows), bool(is_context))), *map(pa.array, total[rows].T.copy())]
            yield pa.record_batch(columns, ["key", "is_context", "n0", "n1"])

    counts = texts.mapInArrow(counted, "key bigint, is_context boolean, n0 bigint, n1 bigint")
    return counts.groupBy("key", "is_context").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The row of each key in an ascending table, -1 where it has none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression with a constant, by Newton's method."""
    rows = np.column_stack([features, np.ones(len(features))])
    weights = np.zeros(rows.shape[1])
    for _ in range(50):
        chance = _sigmoid(rows @ weights)
        slope = rows.T @ (labels - chance) / len(rows) - ridge * weights
        bend = (rows * (chance * (1 - chance))[:, None]).T @ rows / len(rows) + ridge * np.eye(rows.shape[1])
        step = np.linalg.solve(bend, slope)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


# -- scoring ------------------------------------------------------------------


@dataclass(frozen=True)
class _Tables:
    """A part of the model as arrays, ascending by key."""

    levels: list[tuple[np.ndarray, np.ndarray]]  # keys, numbers
    totals: np.ndarray
    shared: tuple[float, float]
    expressions: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    cuts: tuple[int, int]
    part: tuple[int, int]


def _array(table: DataFrame, parts: int, part: int, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = _part(table, parts, part).select("key", *[F.col(c).cast("double") for c in columns]).toArrow()
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys)
    numbers = np.empty((len(keys), len(columns)))
    for i, column in enumerate(columns):
        numbers[:, i] = rows.column(column).to_numpy()[order]
    return keys[order], numbers


def _tables(model: ToxicityModel, part: tuple[int, int]) -> _Tables:
    own = [["n0", "n1"], *[["n0", "n1"] for _ in STEMS[:-1]], ["n0", "n1", "both"]]
    levels = [_array(table, model.cuts[0], part[0], columns) for table, columns in zip(model.levels, own)]
    expressions = _array(model.expressions, model.cuts[0], part[0], ["d0", "d1"])
    contexts = _array(model.contexts, model.cuts[1], part[1], ["l0", "l1"])
    return _Tables(levels, model.totals, model.shared, expressions, contexts, model.cuts, part)


def _chances(words: list[str], tables: _Tables) -> np.ndarray:
    """The probability of each word in each class: 2 x words."""
    chance = None
    for level, letters in reversed(list(enumerate((None, *STEMS)))):
        keys, numbers = tables.levels[level]
        at = _found(keys, _hashes(words, letters))
        counts = np.where(at >= 0, numbers[at].T if len(keys) else 0.0, 0.0)
        if chance is None:
            both = counts[2] if len(keys) else np.zeros(len(words))
            alike = (both + 0.5) / (tables.shared[0] + 0.5 * tables.shared[1] + 0.5)
            chance = np.stack([alike, alike])
        for c in CLASSES:
            total, kinds = tables.totals[level][c], tables.totals[level][2 + c]
            if total:
                count = counts[c] if len(keys) else 0.0
                chance[c] = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * chance[c]) / total
    return chance


def _evidence(ratio: np.ndarray) -> np.ndarray:
    """Log likelihood of a word under the mixture of both models over that under the ordinary one."""
    return np.log1p(SHARE * np.expm1(np.minimum(ratio, 500)))


def _sums(texts: pa.Array, tables: _Tables) -> np.ndarray:
    """Per text, over the words of this part: evidence of words, of expressions, and how many words."""
    words, at, ends = _words(texts)
    own, places = _hashes(words), _hashes(words, STEMS[-1])
    chance = _chances(words, tables)
    of_words = _evidence(np.log(chance[1]) - np.log(chance[0]))[at]
    own, places, chance = own[at], places[at], chance[:, at]
    before = np.concatenate([[0], places[:-1]])
    starts = ends[:-1][np.diff(ends) > 0]
    before[starts] = 0
    mine = (np.mod(places, tables.cuts[0]) == tables.part[0]) & (np.mod(before, tables.cuts[1]) == tables.part[1])
    for order in ORDERS:
        found = _expressions(own, ends, order)
        known = _found(tables.contexts[0], found.context)
        rows = np.flatnonzero((known >= 0) & mine[found.last])
        last = found.last[rows]
        left = tables.contexts[1][known[rows]].T if len(rows) else np.zeros((2, 0))
        entry = _found(tables.expressions[0], found.key[rows])
        share = np.where(entry >= 0, tables.expressions[1][entry].T, 0.0) if len(tables.expressions[0]) else 0.0
        chance[:, last] = left * chance[:, last] + share
    of_expressions = _evidence(np.log(chance[1]) - np.log(chance[0]))
    sums = [np.concatenate([[0.0], np.cumsum(np.where(mine, v, 0.0))])[ends] for v in (of_words, of_expressions, 1.0)]
    return np.diff(np.stack(sums), axis=1)


def _features(words: Column, expressions: Column, n: Column) -> list[Column]:
    some = F.greatest(n, F.lit(1.0))
    return [
        F.asinh(words / some * 100).alias(FEATURES[0]),
        F.asinh(expressions / some * 100).alias(FEATURES[1]),
        F.asinh(words / F.sqrt(some) * 4).alias(FEATURES[2]),
    ]


SUMS = ["s_words", "s_expressions", "n_words"]


def _summed(texts: DataFrame, model: ToxicityModel, part: tuple[int, int], kept: str) -> DataFrame:
    """``kept`` and the sums of this part for ``texts(kept, text)``; a ``kept`` struct named row holds its text itself."""
    shared = _broadcast(texts.sparkSession, _tables(model, part))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(kept)
            text = pc.struct_field(held, "text") if kept == "row" else batch.column("text")
            whole = pa.record_batch([held, text.cast(pa.string())], [kept, "text"])
            for part_of in text_slices(iter([whole]), "text", SLICE):
                sums = _sums(part_of.column("text"), shared.value)
                yield pa.record_batch([part_of.column(kept), *map(pa.array, sums)], [kept, *SUMS])

    schema = StructType([texts.schema[kept]])
    for name in SUMS:
        schema = schema.add(name, "double")
    return texts.mapInArrow(summed, schema)


def _broadcast(spark: SparkSession, tables: _Tables):
    return spark.sparkContext.broadcast(tables)


def _measured(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``row``, all columns of ``docs`` as one, and the features of its text.

    A model in one part is sent to the tasks, and the texts stay where they are. Where it
    has several, each pass adds up the words of its part, and the sums of all passes meet
    their texts by a checksum of 128 bits.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    parts = [(i, j) for i in range(model.cuts[0]) for j in range(model.cuts[1])]
    if len(parts) == 1:
        return _summed(rows, model, parts[0], "row").select("row", *_features(*map(F.col, SUMS)))
    mark = F.md5(text_or_empty("row.text"))
    texts = rows.select(mark.alias("mark"), text_or_empty("row.text").alias("text"))
    firsts = [F.max(name).alias(name) for name in SUMS]  # the same in all copies
    passes = [stored(_summed(texts, model, part, "mark").groupBy("mark").agg(*firsts), "pass") for part in parts]
    sums = reduce(DataFrame.unionAll, passes).groupBy("mark").agg(*[F.sum(name).alias(name) for name in SUMS])
    joined = rows.withColumn("mark", mark).join(sums, "mark")
    return joined.select("row", *_features(*map(F.col, SUMS)))


def score(docs: DataFrame, model: ToxicityModel, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns in ``carry`` and ``score`` (0 to 1) for every row of ``docs(doc_id, text)``.

    The words of a text are compared under the ordinary model and under a mixture of it
    with the toxic one, word by word and with the expressions they end, and the
    log-likelihoods normalised by the text's length. NULL and texts without letters score
    as texts without any sign. Repeated rows score alike; an empty table gives no rows.
    Columns may have any names.
    """
    names = list(dict.fromkeys(["doc_id", *carry, "text"]))
    measured = _measured(docs.select(*[F.col(f"`{c}`") for c in names]), model)
    return measured.select(*[F.col("row")[c].alias(c) for c in ["doc_id", *carry]], _chance(model).alias("score"))


def below(docs: DataFrame, model: ToxicityModel, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, of any names; NULLs, empty and repeated rows as in :func:`score`."""
    return _measured(docs, model).filter(_chance(model) < threshold).select("row.*")


def _chance(model: ToxicityModel) -> Column:
    terms = [
        (F.col(name) - float(model.means[i])) / float(model.spreads[i]) * float(model.weights[i])
        for i, name in enumerate(FEATURES)
    ]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(sum(terms, F.lit(float(model.weights[-1]))))))
