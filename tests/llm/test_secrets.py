"""Fixed patterns against a scan of their own, long texts, what the CRF adds to the patterns."""

import random
import string
import time

import pytest
from pyspark.sql import functions as F

from tablewright.llm import secrets as s

LETTERS = string.ascii_letters + string.digits
WORDS = "the order of a new report was sent on with care by some people in town and we wait for it to come back".split()


def scanned(text):
    """Base spans found character by character, without regular expressions."""
    names = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    value = set(LETTERS + "+/_.=-")
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out = []
    at = 0
    while at < len(text):
        name = next((n for n in names if fold.startswith(n, at)), None)
        if name is None:
            at += 1
            continue
        i = at + len(name)
        i += i < len(text) and text[i] in "\"'"
        while i < len(text) and text[i] == " ":
            i += 1
        if i >= len(text) or text[i] not in ":=":
            at += 1
            continue
        i += 1
        while i < len(text) and text[i] == " ":
            i += 1
        i += i < len(text) and text[i] in "\"'"
        end = i
        while end < len(text) and text[end] in value:
            end += 1
        if end == i:
            at += 1
            continue
        if end - i >= 6:
            out.append(("assign", at, end))
        at = end
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = at + 4
        while end < len(text) and text[end] in string.ascii_uppercase + string.digits:
            end += 1
        if end == at + 4:
            at += 1
            continue
        if end - at >= 20:
            out.append(("access", at, end))
        at = end
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in "0123456789abcdef":
            end += 1
        if end - at >= 24:
            out.append(("hex", at, end))
        at = max(end, at + 1)
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_base_spans_are_those_of_a_plain_scan():
    draw = random.Random(9)
    parts = ["password", "PassWd", "token", "api_key", "API-KEY", "apikey", "secret", "ſecret", "toKen", "AKIA", "AKIAAKIA", "=", ":", " = ", '"', "'", "  ",
             "ab12cd", "0123456789abcdef01234567", "deadbeef" * 3, "X" * 16, "É", "日本", "\n", ".", "-", "+/=", "🔑", "a", "1", "token=token=abcdef", "K"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert s.base_spans(text) == scanned(text), text


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def value(draw):
    return "".join(draw.choice(LETTERS) for _ in range(draw.randint(20, 40)))


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(2)
    rows = []
    for i in range(900):
        text = sentence(draw, 60)
        if i % 3 == 0:
            name = draw.choice(["password", "api_key", "token", "secret"])
            text += f'\n{name} = "{value(draw)}"\n'
        if i % 4 == 0:
            text += f"\nname = \"{draw.choice(WORDS)}\" and size = {draw.randint(1, 10**6)} at 2024-05-{draw.randint(10, 30)}\n"
        rows.append((i, text + sentence(draw, 60)))
    return s.learn(spark.createDataFrame(rows, "doc_id long, text string"))


def test_crf_finds_what_no_pattern_names(spark, model):
    """Values assigned to names that no pattern knows: nearly all are found, and nearly nothing else is."""
    draw = random.Random(3)
    rows, truth = [], {}
    for i in range(600):
        text = sentence(draw, 40)
        if i % 2:
            secret = value(draw)
            text += f'\n{draw.choice(["credential", "signing", "auth", "clientkey"])} = "{secret}"\n'
            truth[i] = (text.index(secret), text.index(secret) + len(secret))
        elif i % 4 == 0:
            text += f'\ntitle = "{draw.choice(WORDS)}" and count = {draw.randint(1, 10**6)}\n'
        rows.append((i, text + sentence(draw, 40)))
    found = s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert not any(r["base_spans"] for r in found)
    tagged = {(r["doc_id"], x["start"], x["end"]) for r in found for x in r["spans"]}
    wanted = {(i, *span) for i, span in truth.items()}
    assert len(tagged & wanted) > 0.9 * len(wanted)
    assert len(tagged & wanted) > 0.9 * len(tagged)


def test_spans_of_long_texts_take_linear_time(model):
    """A dump of settings of 2 MB, in which almost every line is tagged."""
    draw = random.Random(4)
    line = lambda: f'signing = "{value(draw)}"\n'
    text = "".join(line() for _ in range(45_000))
    assert len(text) > 1_800_000
    start = time.perf_counter()
    found = s.Tagger(model).spans([text])[0]
    assert time.perf_counter() - start < 30
    assert len(found) > 40_000
    assert all(text[a - 1] in ' "' or text[a - 1] == "\n" for _, a, _ in found[:1000])


def test_windows_of_long_texts_take_linear_time():
    draw = random.Random(5)
    text = "".join(f'token = "{value(draw)}"\n' for _ in range(20_000))
    start = time.perf_counter()
    assert len(s._windows(text)) >= 20_000
    assert time.perf_counter() - start < 60


def test_copies_of_a_window_count_once(spark):
    """Thousands of copies do not crowd the others out of a small sample."""
    draw = random.Random(6)
    many = [(i, 'copy token = "abcdefABCDEF123456789"') for i in range(3000)]
    few = [(5000 + i, f'{sentence(draw, 20)} signing key: password = "{value(draw)}" {sentence(draw, 20)}') for i in range(60)]
    learned = s.learn(spark.createDataFrame(many + few, "doc_id long, text string"), fit_windows=50)
    found = s.Tagger(learned).spans([f'{sentence(draw, 20)} signing key: password = "{value(draw)}" {sentence(draw, 20)}' for _ in range(20)])
    assert sum(bool(x) for x in found) > 15


def test_odd_rows(spark, model):
    rows = [(1, None), (1, None), (None, ""), (2, "🔑 token = 'abcdef123456'"), (2, "🔑 token = 'abcdef123456'")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base_spans string")
    found = s.find_secrets(table.select("doc_id", "text"), model).collect()
    assert len(found) == 5 and [tuple(x) for r in found if r["doc_id"] == 2 for x in r["base_spans"]] == [("assign", 2, 23)] * 2
    masked = s.mask_secrets(table, model, "[secret]")
    assert masked.schema == table.schema and masked.filter(F.col("text") == "🔑 [secret]'").count() == 2
    assert masked.filter(F.col("text").isNull()).count() == 2
    nothing = s.learn(table.limit(0))
    assert s.find_secrets(table.select("doc_id", "text"), nothing).count() == 5
