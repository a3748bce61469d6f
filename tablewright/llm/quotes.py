"""Conversations in reply order: quoted passages linked to the messages they come from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import schema_of, stored, text_or_empty, text_slices

MARK = re.compile(r"\s*((?:>\s?)+)")
SENTENCE = re.compile(r"""(?<=[.!?…])["'”’»)\]]*\s+|(?<=[。！？])""")
MESSAGE = ["conv_id", "turn"]
PASSAGES = "level int, letters bigint, hash string"


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without its quotes, and each quoted run of lines with its level.

    A line's level is the number of ``>`` it begins with, spaces between them or not.
    Lines that follow one another on one level are one passage.
    """
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.splitlines():
        mark = MARK.match(line)
        level = mark[1].count(">") if mark else 0
        rest = line[mark.end() :] if mark else line
        if not level:
            own.append(rest)
        elif level == last:
            quoted[-1][1].append(rest)
        else:
            quoted.append((level, [rest]))
        last = level
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    return body, [(level, "\n".join(lines)) for level, lines in quoted]


def normalised(passage: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(filter(str.isalnum, passage.lower()))


def _hashed(passage: str) -> tuple[int, str]:
    plain = normalised(passage)
    return len(plain), hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()


def _sentences(passage: str) -> list[str]:
    """The sentences of each paragraph, whose lines are joined: however they are wrapped."""
    paragraphs = re.split(r"\n\s*\n", passage)
    return [x for paragraph in paragraphs for x in SENTENCE.split(" ".join(paragraph.split("\n")))]


def _units(passage: str) -> list[str]:
    """What may be quoted of a passage: all of it, its paragraphs, its lines, its sentences."""
    return [passage, *re.split(r"\n\s*\n", passage), *passage.split("\n"), *_sentences(passage)]


def link(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, each with the message it answers.

    ``messages(conv_id, turn, role, text)`` gives one row per row: ``conv_id, turn, role,
    text`` (the quotes taken out), ``n_quotes`` (quoted passages), ``reply_to`` (a turn,
    NULL for none), ``root`` and ``depth`` (first message of its thread, and steps to it).

    Quoted passages, and what each message says itself (whole, by paragraph, by line, by
    sentence), are normalised and hashed; a passage's origin is the earliest message of
    its conversation that says it. A passage nowhere found whole is looked up by its
    lines and by its sentences, which a new wrapping leaves as they are; of an origin
    that both find the way counts that finds more letters. Passages of any length count
    that have a letter or digit. A message answers the origin of most of its quoted
    letters on the outermost level that has any, the latest of equals; only earlier turns
    count. Sorted by conv_id, root, depth and turn, a conversation reads in reply order.

    NULL text counts as empty. Rows that repeat conv_id and turn say what all of them
    say and get one answer each. Messages without conv_id or turn are kept, unlinked.
    Origins are found by grouping on conversation and hash, so neither a very long
    conversation nor a very common line is gathered in one task. Other columns are not
    looked at; an empty table gives no rows.
    """
    kept = ["conv_id", "turn", "role"]
    rows = messages.select(*kept, text_or_empty().alias("text"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            bodies, counts, said, quoted = [], [], [], []
            for text in part.column("text").to_pylist():
                body, passages = parse(text)
                bodies.append(body)
                counts.append(len(passages))
                said.append([h for n, h in dict.fromkeys(map(_hashed, _units(body))) if n])
                quoted.append([_quote(level, p) for level, p in passages])
            columns = [pa.array(bodies), pa.array(counts, pa.int64()), pa.array(said, pa.list_(pa.string())), pa.array(quoted, QUOTED)]
            yield pa.record_batch([*map(part.column, kept), *columns], [*kept, "text", "n_quotes", "said", "quoted"])

    passage = f"struct<{PASSAGES.replace(' ', ':').replace(',:', ',')}>"
    schema = (
        f"{schema_of(messages, *kept)}, text string, n_quotes bigint, said array<string>, "
        f"quoted array<struct<whole:{passage}, lines:array<{passage}>, sentences:array<{passage}>>>"
    )
    read = stored(rows.mapInArrow(parsed, schema), "messages")
    placed = read.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = placed.filter("n_quotes > 0").select(*MESSAGE, F.posexplode("quoted").alias("place", "quote"))
    asked = stored(asked, "quotes")
    origins = _origins(placed, asked)
    answers = stored(_answers(asked, origins), "answers")
    threads = stored(_threads(answers), "threads")
    return (
        read.join(threads, MESSAGE, "left")
        .withColumns({"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0))})
        .select(*kept, "text", "n_quotes", "reply_to", "root", "depth")
    )


HASHED = pa.struct([("level", pa.int32()), ("letters", pa.int64()), ("hash", pa.string())])
QUOTED = pa.list_(pa.struct([("whole", HASHED), ("lines", pa.list_(HASHED)), ("sentences", pa.list_(HASHED))]))


def _quote(level: int, passage: str) -> dict:
    def hashed(text: str) -> dict:
        letters, digest = _hashed(text)
        return {"level": level, "letters": letters, "hash": digest}

    lines, sentences = ([h for h in map(hashed, parts) if h["letters"]] for parts in (passage.split("\n"), _sentences(passage)))
    return {"whole": hashed(passage), "lines": lines, "sentences": sentences}


def _origins(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """``conv_id, hash, origin``: the earliest turn that says each passage that someone quotes."""
    wanted = asked.select(
        "conv_id", F.explode(F.concat(F.array("quote.whole"), "quote.lines", "quote.sentences")).alias("passage")
    ).select("conv_id", F.col("passage.hash").alias("hash"))
    said = placed.select(*MESSAGE, F.explode("said").alias("hash"))
    first = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    return stored(stored(first, "said").join(stored(wanted.distinct(), "wanted"), ["conv_id", "hash"], "left_semi"), "origins")


def _answers(asked: DataFrame, origins: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to`` of the messages that answer another."""
    whole = asked.select(*MESSAGE, "place", F.col("quote.whole").alias("p"), "quote.lines", "quote.sentences")
    known = origins.withColumnRenamed("hash", "known")
    met = stored(
        whole.withColumn("known", F.col("p.hash")).join(known, ["conv_id", "known"], "left").drop("known"), "whole"
    )
    passage = [*MESSAGE, "place", "origin", F.col("p.level").alias("level")]
    unmet = met.filter("origin IS NULL").drop("origin")
    parts = F.array(*[F.struct(F.lit(way).alias("way"), F.col(way).alias("of")) for way in ("lines", "sentences")])
    by_way = unmet.select(*MESSAGE, "place", F.inline(parts)).select(*MESSAGE, "place", "way", F.explode("of").alias("p"))
    in_part = by_way.withColumn("known", F.col("p.hash")).join(known, ["conv_id", "known"]).filter("origin < turn")
    ways = in_part.groupBy(*passage, "way").agg(F.sum("p.letters").alias("letters"))
    most = ways.groupBy(*MESSAGE, "place", "origin", "level").agg(F.max("letters").alias("letters"))
    found = met.filter("origin < turn").select(*passage, F.col("p.letters").alias("letters")).unionByName(most)
    sums = found.groupBy(*MESSAGE, "level", "origin").agg(F.sum("letters").alias("letters"))
    best = F.max(F.struct((-F.col("level")).alias("outer"), "letters", "origin")).alias("best")
    return sums.groupBy(*MESSAGE).agg(best).select(*MESSAGE, F.col("best.origin").alias("reply_to"))


def _threads(answers: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, root, depth``: every round doubles the steps a message looks back."""
    ahead = answers.select(*MESSAGE, "reply_to", F.col("reply_to").alias("root"), F.lit(1).alias("depth"))
    ahead = stored(ahead, "ahead")
    while True:
        seen = ahead.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = ahead.join(seen, ["conv_id", "root"], "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return ahead
        ahead = stored(
            joined.select(
                *MESSAGE,
                "reply_to",
                F.coalesce("next", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "ahead",
        )
