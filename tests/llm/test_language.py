"""Language identification against plain sets of trigrams, without filters or chance."""

import collections

from pyspark.sql import functions as F

from tablewright.llm import language_id as l
from tablewright.llm.shared import fold_of

FOLDER = "/root/testdata/sf0.01"


def trigrams(text):
    marked = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    return [marked[i - 1 : i + 2] for i in range(1, len(marked) - 1) if marked[i] != " "]


def test_filters_decide_as_sets_do(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", (fold_of("doc_id", 5) == 0).alias("held"))
    model = l.learn(docs.filter(~F.col("held")))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in l.predict(docs.select("doc_id", "text"), model).collect()}
    rows = docs.collect()
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if not r["held"] and r["lang"] is not None:
            counts[r["lang"]].update(trigrams(r["text"]))
    sets = {lang: {g for g, n in c.items() if n >= l.SHARE * sum(c.values())} for lang, c in counts.items()}
    unlike = 0
    for r in rows:
        own = trigrams(r["text"])
        if not own:
            assert found[r["doc_id"]] == (l.UNKNOWN, 0.0)
            continue
        shares = {lang: sum(g in s for g in own) / len(own) for lang, s in sorted(sets.items())}
        best = max(shares.values())
        first = next(lang for lang, share in shares.items() if share == best)
        sure = sorted(shares.values())[-2] < best - 0.02 if len(shares) > 1 else True
        assert not sure or found[r["doc_id"]][0] == first
        unlike += found[r["doc_id"]][0] != first
        assert abs(found[r["doc_id"]][1] - best / max(sum(shares.values()), 1e-9)) < 0.05
    assert unlike <= 0.005 * len(rows)


def test_trigrams_are_those_of_a_plain_cut():
    texts = ["Ab c", "", "É1é--日本", "a", "ſK İx"]
    codes, owners = l.grams(texts)
    plain = [(i, tuple(map(ord, g))) for i, t in enumerate(texts) for g in trigrams(t)]
    mask = (1 << 21) - 1
    assert [(int(o), (int(c) >> 42, int(c) >> 21 & mask, int(c) & mask)) for c, o in zip(codes, owners)] == plain


def test_filters_rarely_find_what_no_language_has(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = l.learn(docs)
    table = spark.createDataFrame([(1, "ЖЗИ КЛМ " * 200)], "doc_id long, text string")
    assert max(model.false_positives) < 0.02
    assert l.predict(table, model).first()["score"] <= 1.0
