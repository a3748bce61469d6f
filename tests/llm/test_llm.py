"""The operators on small tables: against the libraries, brute force, and round trips."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import (
    bpe,
    components,
    exact_dedup,
    language_id,
    packing,
    quotes,
    records,
    secrets,
    shared,
    simhash,
    topk,
    toxicity,
)
from tablewright.llm.checksums import crc32c
from tablewright.llm.token_ids import TextEncoder

FOLDER = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, score double, row string"
ODD = ["", "  ", "a\x1cb", "Don't <|endoftext|>x", "É日本 😀 ß", "x" * 3000, "́a", "a b  \n c"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use too."""
    long = " ".join(random.Random(3).choice(["alpha", "beta", "Gamma,", "delta"]) for _ in range(9000))
    rows = [(1, "one  two three four"), (2, "one two three\tfour"), (3, None), (4, ""), (5, long), (6, long + " end")]
    rows += [(7, "same row"), (7, "same row"), (None, "no id"), (8, "token = 'abcDEF123456'")]
    rows += [(10 + i, t) for i, t in enumerate(ODD)]
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_is_the_library():
    own, library = TextEncoder(WORD), Tokenizer.from_file(WORD)
    draw = random.Random(1)
    letters = "abAB éÉ'́\n\t<|1²½_. ßſKΣσς日\x1d\xa0　"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    ids, ends = own.encode(pa.array([*texts, None]))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_is_the_library():
    own, library = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    draw = random.Random(2)
    letters = "abAB éÉ'́\n\t12_.ßKσ日\x1d😀\xa0"
    texts = ODD + ["ab" * 900, "é" * 700] + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    ids, ends = own.encode(texts)
    decoded = own.decode(ids, ends)
    for i, text in enumerate(texts):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == wanted, text
        assert decoded[i].decode() == library.decode(wanted, skip_special_tokens=False)


def test_bpe_documents(docs, empty):
    found = bpe.round_trip(docs, BYTE).collect()
    assert len(found) == docs.count()
    texts = collections.Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
    assert collections.Counter(r["decoded_sha256"] for r in found) == texts
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in docs.collect())
    assert bpe.round_trip(empty, BYTE).count() == 0


def test_packing_deals_every_id_once(docs, empty):
    library = Tokenizer.from_file(WORD)
    pieces = packing.pack(docs, WORD, end_id=1, window=256, shard_tokens=2000).collect()
    wanted = collections.Counter()
    for row in docs.collect():
        wanted[row["doc_id"], crc(library.encode(row["text"] or "", add_special_tokens=False).ids + [1])] += 1
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        parts[p["doc_id"], p["doc_tokens"]].append(p)
    for (doc, tokens), own in parts.items():
        copies = sum(p["length"] for p in own) // tokens
        by_start = collections.Counter(p["start"] for p in own)
        assert by_start[0] >= 1 and copies * tokens == sum(p["length"] for p in own)
        if copies == 1:
            whole = b"".join(bytes(p["ids"]) for p in sorted(own, key=lambda p: p["start"]))
            assert wanted[doc, zlib.crc32(whole)] == 1
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] * 4 == len(p["ids"])
            at += p["length"]
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(empty, WORD, end_id=1, window=256).count() == 0


def test_seed_takes_its_nearest_neighbour(spark):
    words = {0: "red green blue", 1: "cat dog bird", 2: "sun moon star"}
    rows = [(i, " ".join(random.Random(i).choices(words[i % 3].split(), k=30))) for i in range(12)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD, end_id=1, window=64).collect()
    first = collections.defaultdict(set)
    for p in pieces:
        first[p["sequence_id"]].add(p["doc_id"] % 3)
    assert sum(len(kinds) == 1 for kinds in first.values()) >= len(first) - 4


def test_records_round_trip(spark, docs, empty, tmp_path):
    library = Tokenizer.from_file(WORD)
    records.write_records(docs, str(tmp_path / "r"), WORD, end_id=2, file_bytes=20_000)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    ids = [library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    found = sorted(records.read_index(spark, str(tmp_path / "r")).collect(), key=lambda r: r["start"])
    assert len({r["file"] for r in found}) > 1
    for row, own, start, got in zip(rows, ids, starts, found, strict=False):
        assert (got["doc_id"], got["start"], got["n_tokens"], got["ids_crc32"]) == (row["doc_id"], start, len(own), crc(own))
    drawn = records.read_shuffled(spark, str(tmp_path / "r"), seed=5).collect()
    assert collections.Counter(tuple(r["ids"]) for r in drawn) == collections.Counter(map(tuple, ids))
    records.write_records(empty, str(tmp_path / "none"), WORD, end_id=2)
    assert records.read_index(spark, str(tmp_path / "none")).count() == 0
    broken = next((tmp_path / "r" / "data").glob("part-*"))
    data = bytearray(broken.read_bytes())
    data[14] ^= 1
    for crc_file in (tmp_path / "r" / "data").glob(".*.crc"):
        crc_file.unlink()
    broken.write_bytes(data)
    with pytest.raises(Exception, match="wrong checksum"):
        records.scan_records(spark, str(tmp_path / "r")).collect()


def test_records_task_leaves_no_words_in_the_worker():
    from tablewright.llm.token_ids import encoder

    texts = [f"word{i} Other{i % 7} and more" for i in range(300)] + [None]
    batch = pa.record_batch([pa.array(range(301), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    frames = pa.concat_arrays([b.column("frame") for b in records._encoded(iter([batch]), WORD, end_id=2)])
    assert encoder(WORD).known == {} and len(encoder(WORD).flat) == 0
    library = Tokenizer.from_file(WORD)
    data = np.frombuffer(b"".join(f + b"\n" for f in frames.to_pylist()), np.uint8)
    found = records._parsed(0, data)
    own = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert found.column("doc_id").to_pylist() == list(range(301))
    assert found.column("ids_crc32").to_pylist() == [crc(i) for i in own]


def test_checksum_has_the_known_value():
    data = np.frombuffer(b"123456789" + bytes(5000), np.uint8)
    assert hex(crc32c(data, np.array([0, 3]), np.array([9, 0]))[0]) == "0xe3069283"


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[ \t-\r]", "", r["text"] or "")].append(r)
    found = exact_dedup.duplicates(docs, block=16, carry=["row"]).collect()
    assert len(found) == docs.count() and sum(r["kept"] for r in found) == len(groups)
    for bare, own in groups.items():
        got = [r for r in found if r["text_sha256"] == hashlib.sha256(bare.encode()).hexdigest()]
        best = min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        assert {(r["keep_id"], r["group_size"]) for r in got} == {(best["doc_id"], len(own))} and len(got) == len(own)
    assert exact_dedup.duplicates(empty).count() == 0


def test_simhash_against_all_pairs(spark, docs, empty):
    draw = random.Random(4)
    base = [[draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(60)] = "Z"
        rows.append((i, " ".join(words)))
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + i, t) for i, t in rows], "doc_id long, text string"))
    marked = simhash.fingerprints(table, shingle=4)
    found = simhash.near_duplicates(marked, 4, simhash.all_within(4, 6)).collect()
    prints = {}
    for r in table.collect():
        words = (r["text"] or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        value = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))
        prints.setdefault(value, []).append(r["doc_id"])
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min((root[b] for b in prints if bin(a ^ b).count("1") <= 4), key=lambda x: x)
            if low < root[a]:
                root[a], changed = low, True
    named = collections.defaultdict(list)
    for p, ids in prints.items():
        named[root[p]] += [i for i in ids if i is not None]
    wanted = {(i, min(named[root[p]], default=None)) for p, ids in prints.items() for i in ids}
    assert {(r["doc_id"], r["component_id"]) for r in found} == wanted and len(found) == table.count()
    assert simhash.near_duplicates(simhash.fingerprints(empty, 4), 4, simhash.all_within(4, 6)).count() == 0


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    draw = np.random.default_rng(0)
    values = {0}
    while len(values) < 400:
        values.add(int(sum(1 << int(b) for b in draw.choice(24, 3, replace=False))))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(values))], "doc_id long, f0 long")
    found = simhash.near_duplicates(rows, 4, simhash.all_within(4, 6)).collect()
    assert {r["component_id"] for r in found} == {0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100 and all(found[200 + i] == 200 for i in range(30))


def test_language_id(spark, docs, empty):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.learn(table.filter(shared.fold_of("doc_id", 5) != 0))
    found = language_id.predict(table.filter(shared.fold_of("doc_id", 5) == 0), model).join(table, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) > 0.9 * len(found)
    marks = docs.select("doc_id", "text").filter("text IS NULL OR text = '' OR text = '  '")
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(marks, model).collect()} == {("und", 0.0)}
    none = language_id.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_toxicity(spark, docs, empty):
    table = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.lit("plain words and more"), F.col("id"), F.when(F.col("id") % 3 == 0, "you idiot scum")).alias("text"),
        (F.col("id") % 3 == 0).cast("int").alias("toxic"),
    )
    model = toxicity.learn(table)
    new = spark.createDataFrame([(1, "what an idiot and scum"), (2, "plain words"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert found[1] >= 0.7 > 0.3 > found[2] and 0 <= found[3] < 0.3
    assert toxicity.below(docs, model, 0.7).columns == docs.columns
    assert toxicity.below(docs, model, 0.7).count() == docs.count()
    flat = toxicity.learn(table.limit(0))
    assert {r["score"] < 1e-6 for r in toxicity.score(docs, flat).collect()} == {True}
    assert toxicity.score(empty, model).count() == 0


def test_secrets(spark, docs, empty):
    values = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(300)]
    text = [f"some words here token = \"{v}\" and then more words {i}" for i, v in enumerate(values)]
    learned = secrets.learn(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string"))
    found = secrets.find_secrets(docs, learned).collect()
    for row in found:
        assert set(map(tuple, row["base_spans"])) <= set(map(tuple, row["spans"]))
    held = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found}
    assert held[8][0][0] == "assign" and held[3] == []
    tagged = secrets.Tagger(learned).spans(["the pin = \"" + values[0][:20] + "\" and more words"])
    assert tagged == [[("tagged", 11, 31)]]
    clean = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs, learned, "[secret]").collect()}
    assert "abcDEF" not in clean[8] and clean[3] is None and clean[1] == "one  two three four"
    assert secrets.find_secrets(empty, learned).count() == 0


def test_pruned_viterbi_is_viterbi():
    draw = np.random.default_rng(2)
    model = secrets.Crf(draw.normal(0, 1, (secrets.FEATURES, 3)), draw.normal(0, 0.5, (3, 3)))
    tagger = secrets.Tagger(model)
    for _ in range(50):
        words = ["".join(draw.choice(list("ab1A"), draw.integers(1, 6))) for _ in range(12)]
        text = " ".join(words)
        scores = np.array([model.weights[list(f)].sum(0) for f in secrets._features(words, secrets._file_signs(text))])
        tags = tagger._viterbi(scores, False, False)
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        assert tagger.spans([text])[0] == secrets._joined(starts, words, tags)


def test_topk_against_all_products(spark):
    draw = np.random.default_rng(1)
    points = draw.integers(-20, 20, (400, 8)).astype(float)
    points[100:250] = points[100]
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, None]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table.filter("vec_id % 50 = 0"), table, 5).collect()}
    for query in range(0, 400, 50):
        order = sorted((-float(points[query] @ points[j]), j) for j in range(400) if j != query)[:5]
        assert [found[query, k + 1] for k in range(5)] == [(j, -s) for s, j in order]
    assert len(found) == 40
    assert topk.top_k(table.limit(0), table, 5).count() == 0 and topk.top_k(table, table.limit(0), 5).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "a", "First thought.\n\nSecond thought here."), (1, 1, "b", "> second THOUGHT, here\nI agree."),
        (1, 2, "a", ">> Second thought here.\n> I agree.\nGood."), (1, 3, "b", "> never said by anyone\nhm"),
        (1, 4, "b", None), (2, 0, "a", "> First thought.\nother talk"), (None, 0, "a", "> x"), (1, 4, "b", None),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [r for r in quotes.link(table).collect()]
    assert len(found) == len(rows)
    by = {(r["conv_id"], r["turn"]): (r["text"], r["n_quotes"], r["reply_to"], r["root"], r["depth"]) for r in found}
    assert by[1, 1] == ("I agree.", 1, 0, 0, 1)
    assert by[1, 2] == ("Good.", 2, 1, 0, 2)
    assert by[1, 3] == ("hm", 1, None, 3, 0) and by[2, 0] == ("other talk", 1, None, 0, 0) and by[1, 4][0] == ""
    assert quotes.link(table.limit(0)).count() == 0


def test_pipeline_stages(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = table.columns
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.stored(stage(spark, kept, FOLDER), "stage")
        assert after.columns == columns, name
        assert after.select("doc_id").exceptAll(kept.select("doc_id")).isEmpty()
        kept = after
    bare = [re.sub(r"\s", "", r["text"]) for r in kept.collect()]
    assert len(bare) == len(set(bare))
    assert not any(secrets.base_spans(r["text"]) for r in kept.collect())
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.select("doc_id").distinct().count() == kept.count()


def near_texts():
    """Groups of near copies, chains of them, exact copies, short and empty texts."""
    draw = random.Random(11)
    texts = []
    for i in range(60):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([3, 10, 90, 400]))]
        texts.append(" ".join(base))
        for _ in range(4):
            base = list(base)
            base[draw.randrange(len(base))] = f"x{draw.randrange(3000)}"
            texts.append(draw.choice([" ", "\t", "  "]).join(base))
    return texts + ["a", "A", "a b", "", None, " \n", texts[0], texts[0].upper()]


def test_near_dedup_stage_is_that_of_all_pairs(spark):
    texts = near_texts()
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[5], 2, "y"), (None, "quite alone", 3, "z"), (7, texts[7], 4, "w")]
    table = spark.createDataFrame(rows, "doc_id long, text string, id int, `row` string").repartition(3)

    def print_of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints, root = [print_of(r[1]) for r in rows], list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    groups = collections.defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(rows[i][0])
    wanted = collections.Counter(min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values())
    found = corpus_pipeline.distinct_fingerprints(spark, table, FOLDER)
    assert found.schema == table.schema
    assert collections.Counter(r["doc_id"] for r in found.collect()) == wanted
    assert 100 < sum(wanted.values()) < len(rows) - 100
    assert corpus_pipeline.distinct_fingerprints(spark, table.limit(0), FOLDER).schema == table.schema


STAGES = [s for s in corpus_pipeline.STAGES if s[0] != "packing"]


@pytest.mark.parametrize("name,stage", STAGES, ids=[n for n, _ in STAGES])
def test_stages_take_any_names_and_odd_rows(spark, name, stage):
    """Nulls, empty and repeated rows, no rows, and columns that have the names of what stages add."""
    names = "doc_id long, text string, lang string, source string, n_chars long"
    more = ["row", "id", "best", "none", "kept", "mark", "_whole_text", "_per_word", "_per_root", "_pipeline_row", "spans", "keep_id"]
    plain = "Nothing but plain words in a row that nobody would mind at all"
    rows = [(1, plain, "en", "a", 62), (1, plain, "en", "a", 62), (None, None, None, None, None), (None, "", None, None, 0)]
    rows += [(4, None, "en", "a", None), (5, "x " * 40_000, "en", "b", 80_000), (6, plain, "en", "a", 62)]
    table = spark.createDataFrame([(*r, *["v"] * len(more)) for r in rows], names + "".join(f", `{m}` string" for m in more))
    found = stage(spark, table, FOLDER)
    assert found.schema == table.schema
    kept = collections.Counter(map(tuple, found.collect()))
    assert kept <= collections.Counter(map(tuple, table.collect()))
    sizes = {"toxicity": 7, "exact dedup": 3, "near dedup": 3, "secrets": 7}
    assert sum(kept.values()) == sizes[name]
    if "dedup" in name:
        assert {r[0] for r in kept} == {1, 4, 5}
    nothing = stage(spark, table.limit(0), FOLDER)
    assert nothing.schema == table.schema and nothing.count() == 0
