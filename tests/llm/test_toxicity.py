"""The two Kneser-Ney models against a plain version, expressions, parts of a model, odd tables."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import toxicity as t


def tokens(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain(rows):
    """A function that gives the sums of a text: the formulas with dictionaries, word by word."""
    counted = [(tokens(text), x) for i, text, x in rows if x in (0, 1) and zlib.crc32(str(i).encode()) % 12 // 3]
    levels = [[collections.Counter(), collections.Counter()]]
    for words, x in counted:
        levels[0][x].update(words)
    both = set(levels[0][0]) | set(levels[0][1])
    for letters in t.STEMS:
        levels.append([collections.Counter(w[:letters] for w in levels[-1][c]) for c in (0, 1)])
        alike = collections.Counter(w[:letters] for w in both)
        both = set(alike)

    def word(w):
        stem = w[: t.STEMS[-1]]
        base = (alike[stem] + 0.5) / (sum(alike.values()) + 0.5 * len(alike) + 0.5)
        p = [base, base]
        for level, letters in reversed(list(zip(levels, (None, *t.STEMS)))):
            for c in (0, 1):
                if total := sum(level[c].values()):
                    p[c] = (max(level[c][w[:letters]] - t.DISCOUNT, 0) + t.DISCOUNT * len(level[c]) * p[c]) / total
        return p

    grams = [collections.Counter(), collections.Counter()]
    for words, x in counted:
        grams[x].update({tuple(words[i : i + k + 1]) for k in t.ORDERS for i in range(len(words) - k)})
    kept = {e for e, n in grams[1].items() if n >= t.LEAST_TEXTS}
    contexts = {e[:-1] for e in kept}
    total = [collections.Counter(), collections.Counter()]
    for c in (0, 1):
        for e, n in grams[c].items():
            total[c][e[:-1]] += n
    share = lambda c, e: max(grams[c][e] - t.EXPRESSION_DISCOUNT, 0) / total[c][e[:-1]] if total[c][e[:-1]] else 0.0
    left = {u: [1 - sum(share(c, e) for e in kept if e[:-1] == u) for c in (0, 1)] for u in contexts}
    evidence = lambda p: math.log1p(t.SHARE * math.expm1(math.log(p[1]) - math.log(p[0])))

    def sums(text):
        words = tokens(text)
        alone = together = 0.0
        for i, w in enumerate(words):
            p = word(w)
            alone += evidence(p)
            for k in t.ORDERS:
                u = tuple(words[max(i - k, 0) : i])
                if i >= k and u in contexts:
                    p = [left[u][c] * p[c] + (share(c, (*u, w)) if (*u, w) in kept else 0.0) for c in (0, 1)]
            together += evidence(p)
        return alone, together, len(words)

    return sums


def made(n=500, seed=3):
    """Common words, some stems with endings, toxic words of one stem, and expressions that only toxic texts use."""
    draw = random.Random(seed)
    common = [f"{''.join(draw.choice('abcdé') for _ in range(draw.randint(1, 9)))}" for _ in range(60)]
    rows = []
    for i in range(n):
        words = [draw.choice(common) for _ in range(draw.randint(0, 40))]
        toxic = int(draw.random() < 0.3)
        if toxic:
            words.insert(draw.randint(0, len(words)), draw.choice(["verybad" + e for e in ("", "der", "ness", "ly")] + ["get out now"]))
        elif draw.random() < 0.3:
            words.insert(draw.randint(0, len(words)), draw.choice(["now out get", "out", "get"]))
        rows.append((i, draw.choice([" ", ", ", "\n", " 7 "]).join(words), toxic))
    rows += [(1000, None, 0), (1001, "", 1), (1002, "123 !", 0), (1003, "no label", None), (1004, "odd label", 5)]
    return rows


def features(sums):
    alone, together, n = sums
    n = max(n, 1)
    return [math.asinh(100 * alone / n), math.asinh(100 * together / n), math.asinh(4 * alone / math.sqrt(n))]


@pytest.mark.parametrize("entries", [t.ENTRIES, 40], ids=["whole", "parts"])
def test_sums_are_those_of_the_plain_formulas(spark, entries):
    rows = made()
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = t.learn(table, entries=entries)
    assert (model.cuts == (1, 1)) == (entries == t.ENTRIES)
    assert model.cuts[1] > 1 or entries == t.ENTRIES
    found = {r["row"]["doc_id"]: [r[f] for f in t.FEATURES] for r in t._measured(table, model).collect()}
    sums = plain(rows)
    assert len(found) == len(rows)
    for i, text, _ in rows:
        assert found[i] == pytest.approx(features(sums(text)), rel=1e-9, abs=1e-12), (i, text)


def test_parts_of_a_model_give_the_scores_of_the_whole(spark):
    table = spark.createDataFrame(made(), "doc_id long, text string, toxic int")
    whole, parts = t.learn(table), t.learn(table, entries=60)
    twice = table.unionByName(table.limit(50))
    scores = [
        sorted((str(r["doc_id"]), r["toxic"], round(r["score"], 9)) for r in t.score(twice, m, carry=["toxic"]).collect()) for m in (whole, parts)
    ]
    assert scores[0] == scores[1] and len(scores[0]) == twice.count()


def test_expressions_of_common_words_are_met(spark):
    """Every word is as common in both classes; only their order tells the classes apart."""
    draw = random.Random(1)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(1500):
        words = [draw.choice(common) for _ in range(30)]
        words[draw.randrange(30)] = "go away" if i % 2 else "away go"
        rows.append((i, " ".join(words), i % 2))
    learned, held = [r for r in rows if r[0] % 5], [r for r in rows if r[0] % 5 == 0]
    model = t.learn(spark.createDataFrame(learned, "doc_id long, text string, toxic int"))
    found = t.score(spark.createDataFrame(held, "doc_id long, text string, toxic int"), model, carry=["toxic"]).collect()
    assert sum((r["score"] >= 0.7) == bool(r["toxic"]) for r in found) > 0.97 * len(found)


def test_columns_of_any_name_stay(spark):
    model = t.learn(spark.createDataFrame(made(), "doc_id long, text string, toxic int"))
    names = "doc_id long, text string, row string, mark string, key long, s_words double, words_mean double, toxic int, `a b` int"
    rows = [(1, "verybadness", "r", "m", 1, 0.1, 0.2, 1, 3), (2, None, "r", None, None, None, None, None, None), (None, "", "r", "m", 1, 0.1, 0.2, 1, 3)]
    table = spark.createDataFrame([*rows, rows[2]], names)
    kept = t.below(table, model, 0.7)
    assert kept.schema == table.schema
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([*rows[1:], rows[2]], key=repr)
    assert t.below(table.limit(0), model, 0.7).schema == table.schema
    scored = t.score(table, model, carry=["row", "mark", "words_mean"])
    assert scored.columns == ["doc_id", "row", "mark", "words_mean", "score"] and scored.count() == 4


def test_fit_rows_are_bounded(spark):
    table = spark.createDataFrame(made(), "doc_id long, text string, toxic int")
    few = t.learn(table, fit_rows=40)
    assert few.weights.any() and t.score(table, few).filter(F.col("score").between(0, 1)).count() == table.count()


def test_pipeline_stage_lets_toxic_texts_go_and_keeps_the_others(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.not_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    count = lambda rows: {r["toxic"]: r["count"] for r in rows.join(labels, "doc_id").groupBy("toxic").count().collect()}
    before, after = count(docs), count(kept)
    assert after[0] > 0.99 * before[0] and after.get(1, 0) < 0.5 * before[1]
