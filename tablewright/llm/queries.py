"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    bpe,
    exact_dedup,
    filter_audit,
    language_id,
    line_dedup,
    packing,
    quotes,
    records,
    secrets,
    simhash,
    spelling,
    topk,
    toxicity,
)
from tablewright.llm.shared import fold_of, shared_folder
from tablewright.sources.parquet import scan

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
SHINGLE, RADIUS, SIMHASH_PARTS = 4, 4, 6  # words, bits, and parts of a fingerprint whose choices are its keys


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(scan(spark, folder, "documents"), public_tokenizers.path(WORD_BPE), end_id=1, window=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicates(scan(spark, folder, "documents"))


def op3_records(spark: SparkSession, folder: str) -> DataFrame:
    written = shared_folder(spark, "records")
    records.write_records(scan(spark, folder, "documents"), written, public_tokenizers.path(WORD_BPE), end_id=2)
    index = records.read_index(spark, written)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "frame_bytes")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold_of("doc_id", 5) == 0
    model = language_id.learn(docs.filter(~held_out))
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.predict(marked, model, carry=["held_out"])


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(scan(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    marked = simhash.fingerprints(scan(spark, folder, "documents"), shingle=SHINGLE)
    classes = simhash.near_duplicates(marked, RADIUS, simhash.all_within(RADIUS, parts=SIMHASH_PARTS))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op7_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.link(scan(spark, folder, "conversations"))


def _spelled(spans: str) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.learn(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(_spelled("base_spans"), 256).alias("base_sha256"),
        _spelled("spans").alias("spans"),
    )


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    held = scan(spark, folder, "embeddings").filter(topk.usable(F.col("embedding")))
    vectors = held.select("vec_id", whole.alias("vector"))
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


TOXIC = 0.7


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled rows of ``docs`` whose checksum mod 3 is not 1.

    A doc_id that several labels name is toxic if one of them says so. Texts that cannot be
    learned from are left out first; the others move once, at every size.
    """
    labels = scan(spark, folder, "labels").filter(fold_of("doc_id", 3) != 1)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.filter(fold_of("doc_id", 3) != 1).select("doc_id", "text")
    return toxicity.learn(texts.join(labels.hint("shuffle_hash"), "doc_id"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, folder, docs))
    return scored.select(
        "doc_id",
        (fold_of("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text")
    return spelling.variants(spelling.word_counts(docs, least_length=5, least_count=3))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(filter_audit.failures(docs, part="source"), scan(spark, folder, "labels"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.digests(docs, line_dedup.keep_bitmaps(docs, least_length=40, least_docs=5))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_records": op3_records,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_quotes": op7_quotes,
    "op8_secrets": op8_secrets,
    "op9_topk": op9_topk,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {
    "op2_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY bare) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(bare) AS text_sha256
        FROM bare WINDOW w AS (PARTITION BY bare ORDER BY size DESC, doc_id)
    """,
    "op9_topk": """
        WITH vectors AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op12_filter_audit": r"""
        WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
        failed AS (
            SELECT doc_id, part,
                   len(words) < 200 AS a,
                   100 * len(list_distinct(words)) < 50 * len(words) AS b,
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
                   regexp_matches(text, '[#$%&*|]') AS d,
                   EXISTS (SELECT 1 FROM docs s WHERE s.text = words.text AND s.doc_id < words.doc_id) AS e
            FROM words
        ),
        said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        combined AS (
            SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
                   count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
            FROM failed LEFT JOIN said USING (doc_id) GROUP BY ALL
        ),
        letters AS (SELECT chr(65 + i::INT) AS letter, (2 ** i)::INT AS bit FROM range(5) r(i)),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ),
        steps AS (
            SELECT filter_order, step::INT AS step, letter, bit,
                   (SELECT coalesce(sum(l.bit), 0)::INT FROM letters l
                    WHERE contains(left(filter_order, step::INT - 1), l.letter)) AS gone
            FROM orders, range(1, 6) s(step) JOIN letters ON letter = filter_order[step]
        ),
        summed AS (
            SELECT part, filter_order, step, letter,
                   sum(n) FILTER (WHERE mask & (bit | gone) = 0) AS kept,
                   sum(n) FILTER (WHERE mask & bit > 0 AND mask & gone = 0) AS removed,
                   sum(n) FILTER (WHERE mask & bit > 0 AND mask & gone > 0) AS redundant,
                   sum(n) FILTER (WHERE mask = bit) AS unique_fails,
                   sum(good) FILTER (WHERE mask & bit > 0 AND mask & gone = 0) AS good_lost,
                   sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & gone = 0) AS toxic_lost
            FROM combined, steps GROUP BY ALL
        )
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
        FROM summed
    """,
    "op13_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS position
            FROM documents
        ),
        keyed AS (
            SELECT *, translate(
                       regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ),
        shared AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ),
        judged AS (
            SELECT doc_id, line, position, coalesce(doc_id <> last, FALSE) AS dropped
            FROM keyed LEFT JOIN shared USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """.replace("\\\\", "\\"),
}
