"""Neighbours by BM25: against plain sums, over many shards, with copies."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tablewright.llm import packing as p

WORD = public_tokenizers.path("word_bpe_49k.json")


def plain(docs, window):
    """Greedy windows with BM25 sums by dictionaries: ``(document, start, length, offset)`` per full window."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    frequency = collections.Counter(t for d in docs for t in set(d))
    idf = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}

    def score(seed, other):
        counts = collections.Counter(docs[other])
        norm = p.K1 * (1 - p.B + p.B * len(docs[other]) / mean)
        return sum(idf[t] * counts[t] * (p.K1 + 1) / (counts[t] + norm) for t in set(docs[seed]) if t in counts and idf[t] > 0)

    unused, sequences, seed, seed_from = list(range(n)), [], None, 0
    while unused or seed is not None:
        if seed is None:
            seed, seed_from = unused.pop(0), 0
        own, filled = [(seed, seed_from, len(docs[seed]) - seed_from)], len(docs[seed]) - seed_from
        order = sorted(unused, key=lambda d: (-round(score(seed, d), 9), d))
        seed = None
        for d in order:
            if filled >= window:
                break
            size = min(len(docs[d]), window - filled)
            own.append((d, 0, size))
            unused.remove(d)
            filled += size
            if size < len(docs[d]):
                seed, seed_from = d, size
        if filled == window:
            sequences.append(own)
    return sequences


def test_windows_are_those_of_plain_bm25():
    draw = random.Random(1)
    docs = [[draw.choice(range(1, 60)) for _ in range(draw.randint(1, 30))] for _ in range(150)]
    docs += [list(docs[3])] * 3
    shard = pa.table({
        "doc_id": pa.array(range(len(docs)), pa.int64()),
        "start": pa.array([0] * len(docs), pa.int64()),
        "doc_tokens": pa.array([len(d) for d in docs], pa.int64()),
        "length": pa.array([len(d) for d in docs], pa.int64()),
        "ids": pa.array([np.array(d, "<u4").tobytes() for d in docs], pa.binary()),
    })
    frequency = np.zeros(60)
    for d in docs:
        frequency[list(set(d))] += 1
    idf = np.log((len(docs) - frequency + 0.5) / (frequency + 0.5))
    found = p._packed(shard, 0, idf, sum(map(len, docs)) / len(docs), window=64).to_pylist()
    own = collections.defaultdict(list)
    for row in found:
        own[row["sequence_id"]].append((row["doc_id"], row["start"], row["length"]))
    full = [pieces for _, pieces in sorted(own.items()) if sum(x[2] for x in pieces) == 64]
    wanted = plain(docs, 64)
    assert len(wanted) > 20 and full[: len(wanted)] == wanted


def test_near_copies_meet_over_many_shards(spark):
    """A thousand pairs whose texts differ in a few words and fill most of a window, dealt over some twenty shards."""
    draw = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je") for b in ("lam", "rin", "tos", "vek", "zul", "mop") for c in ("", "er", "ing", "ed", "ly", "ton", "ia")]
    rows = []
    for i in range(1000):
        text = [draw.choice(words) for _ in range(380)]
        rows.append((2 * i, " ".join(text)))
        for _ in range(5):
            text[draw.randrange(380)] = draw.choice(words)
        rows.append((2 * i + 1, " ".join(text)))
    draw.shuffle(rows)
    tokens = sum(len(e.ids) + 1 for e in Tokenizer.from_file(WORD).encode_batch([t for _, t in rows], add_special_tokens=False))
    for shards, least in ((1, 990), (20, 900)):
        pieces = p.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD, 1, 2048, -(-tokens // shards)).collect()
        held = collections.defaultdict(set)
        for x in pieces:
            held[x["doc_id"]].add(x["sequence_id"])
        assert sum(bool(held[2 * i] & held[2 * i + 1]) for i in range(1000)) >= least, shards
        assert sum(x["length"] for x in pieces) == tokens


def test_copies_are_cut_over_shards(spark):
    rows = [(i, "the very same text of a few words") for i in range(3000)] + [(i, None) for i in range(3000, 3100)]
    pieces = p.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD, 1, 128, 2000).collect()
    sizes = collections.Counter()
    for x in pieces:
        sizes[x["sequence_id"]] += x["length"]
    assert set(sizes.values()) <= {128, 64, 32, 16, 8, 4, 2, 1}
    assert len({s >> 23 for s in sizes}) > 5
    assert {x["doc_id"] for x in pieces} == set(range(3100))


def test_signatures_agree_as_often_as_documents_share():
    draw = np.random.default_rng(3)
    one = draw.integers(0, 4000, (1500, 300))
    near, far = one.copy(), draw.integers(0, 4000, (1500, 300))
    near[:, 100:104] = far[:, 100:104]
    signs = [np.stack(p._signature(x.reshape(-1), np.full(1500, 300))) for x in (one, one, near, far)]
    agree = [(signs[0] == other).mean(axis=1) for other in signs[1:]]
    assert (agree[0] == 1).all() and (agree[1] > 0.9).all() and (agree[2] < 0.1).all()


def test_signatures_stay_within_a_piece():
    """What stands before and after a piece does not matter, short pieces included."""
    draw = np.random.default_rng(4)
    pieces = [draw.integers(0, 50, n) for n in (1, 5, 6, 7, 40, 2, 1)]
    together = np.stack(p._signature(np.concatenate(pieces), np.array([len(x) for x in pieces])))
    alone = np.concatenate([np.stack(p._signature(x, np.array([len(x)]))) for x in pieces], axis=1)
    assert (together == alone).all()
    assert all(t in x for t, x in zip(together[0], pieces))
