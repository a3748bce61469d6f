"""Reply links against a plain version: re-wrapped, partial and very short quotes, nested levels, odd rows."""

import collections
import random
import re
import textwrap

from tablewright.llm import quotes as q

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = "we could meet at noon if the train is late again because nobody told me about that plan".split()


def plain_letters(text):
    return "".join(c for c in text.lower() if c.isalnum())


def sentences(text):
    return [x for p in re.split(r"\n\s*\n", text) for x in re.split(r"""(?<=[.!?…])["'”’»)\]]*\s+|(?<=[。！？])""", p.replace("\n", " "))]


def plain_links(rows):
    """``(conv_id, turn) -> reply_to`` by looking at all earlier messages of a conversation for every quote."""
    said = collections.defaultdict(list)
    parsed = {}
    for conv, turn, _, text in rows:
        body, passages = q.parse(text or "")
        parsed.setdefault((conv, turn), []).extend(passages)
        units = [body, *re.split(r"\n\s*\n", body), *body.split("\n"), *sentences(body)]
        said[conv].append((turn, {plain_letters(u) for u in units} - {""}))

    def origin(conv, text):
        turns = [t for t, units in said[conv] if plain_letters(text) in units]
        return min(turns, default=None)

    links = {}
    for (conv, turn), passages in parsed.items():
        sums = collections.Counter()
        for level, passage in passages:
            if not plain_letters(passage):
                continue
            whole = origin(conv, passage)
            if whole is not None:
                if whole < turn:
                    sums[level, whole] += len(plain_letters(passage))
                continue
            ways = []
            for parts in (passage.split("\n"), sentences(passage)):
                own = collections.Counter()
                for part in parts:
                    at = origin(conv, part) if plain_letters(part) else None
                    if at is not None and at < turn:
                        own[at] += len(plain_letters(part))
                ways.append(own)
            for at in set(ways[0]) | set(ways[1]):
                sums[level, at] += max(ways[0][at], ways[1][at])
        if sums:
            level = min(level for level, _ in sums)
            links[conv, turn] = max((n, at) for (own, at), n in sums.items() if own == level)[1]
    return links


def message(draw):
    paragraphs = []
    for _ in range(draw.randint(1, 3)):
        text = " ".join(" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 9))).capitalize() + draw.choice(".!?") for _ in range(draw.randint(1, 4)))
        paragraphs.append(textwrap.fill(text, draw.choice([30, 60, 200])))
    return "\n\n".join(paragraphs)


def conversation(draw, conv):
    rows, bodies = [], []
    for turn in range(draw.randint(2, 9)):
        body = draw.choice(["OK", "No", "好", message(draw), message(draw), message(draw)])
        quoted = ""
        if bodies and draw.random() < 0.8:
            other = draw.choice(bodies)
            way = draw.randrange(5)
            if way == 1:
                other = draw.choice(other.split("\n"))
            elif way == 2:
                other = draw.choice(sentences(other))
            elif way == 3:
                other = textwrap.fill(" ".join(other.split()), 25)
            elif way == 4:
                some = sentences(other)
                first = draw.randrange(len(some))
                other = textwrap.fill(" ".join(some[first : first + 2]), 25)
            level = draw.choice(["> ", ">> ", "> > "])
            quoted = "\n".join(level + line for line in other.split("\n")) + "\n"
            if draw.random() < 0.2:
                quoted += "> what nobody said\n"
        rows.append((conv, turn, "user", quoted + body))
        bodies.append(body)
    return rows


def test_links_are_those_of_a_plain_search(spark):
    draw = random.Random(7)
    rows = [r for conv in range(150) for r in conversation(draw, conv)]
    found = q.link(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in found if r["reply_to"] is not None}
    wanted = plain_links(rows)
    assert got == wanted and len(wanted) > 300


def test_threads_follow_the_links(spark):
    draw = random.Random(8)
    rows = [r for conv in range(40) for r in conversation(draw, conv)]
    found = {(r["conv_id"], r["turn"]): r for r in q.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    for (conv, turn), row in found.items():
        steps, at = 0, turn
        while found[conv, at]["reply_to"] is not None:
            at, steps = found[conv, at]["reply_to"], steps + 1
        assert (row["root"], row["depth"]) == (at, steps)


def test_sentence_wrapped_and_two_letter_quotes(spark):
    rows = [
        (1, 0, "user", "The train is late. We could meet at noon instead, if that suits you. Nobody told me."),
        (1, 1, "user", "> We could meet at noon\n> instead, if that suits you.\nOK"),
        (1, 2, "user", "> OK\nNo"),
        (1, 3, "user", "> No\n> \nwhy"),
        (1, 4, "user", "> We could meet at noon instead, if that suits you. Nobody\n> told me.\nfine"),
        (2, 0, "user", "OK"),
        (2, 1, "user", "> No\nother talk"),
        (3, 0, "user", "> 好\nfirst"),
        (3, 1, "user", "好"),
        (3, 2, "user", ">好\nlater"),
    ]
    found = {(r["conv_id"], r["turn"]): r["reply_to"] for r in q.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[1, t] for t in range(5)] == [None, 0, 1, 2, 0]
    assert found[2, 1] is None and found[3, 0] is None and found[3, 2] == 1


def test_odd_rows(spark):
    rows = [(1, 0, "a", None), (1, 1, None, ""), (1, 1, None, ""), (None, 0, "a", "> x\ny"), (1, None, "a", "x"), (2, 0, "a", ">" * 50 + " x"), (2, 1, "a", ">\n> \n>>")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' AS hash", "1 AS depth0", "'p' AS place")
    found = q.link(table).collect()
    assert len(found) == len(rows) and all(r["reply_to"] is None for r in found)
    assert q.link(table.limit(0)).count() == 0
