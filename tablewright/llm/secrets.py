"""Secrets in whole texts: fixed patterns, and a linear-chain CRF that adds to them."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import string
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import bounds, schema_of, stored, text_or_empty, text_slices

# fixed patterns: what counts as a secret in any case, and the least length
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of such characters matches whole or not at all
KINDS = ("assign", "access", "hex", "tagged")

INSIDE = r"A-Za-z0-9+/_.=\-"
TOKEN = re.compile(rf"[{INSIDE}]+|[^\s{INSIDE}]", re.ASCII)
O, B, I = range(3)  # noqa: E741
FEATURES = 1 << 16
WINDOW = 24  # tokens on either side of a place to learn from
FIT_WINDOWS = 4_000
EPOCHS = 6
SPANS = "array<struct<kind:string, start:bigint, end:bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by start, then kind in the order of KINDS."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# -- features -----------------------------------------------------------------


def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


SHAPES = str.maketrans(string.ascii_letters + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
REPEATS = re.compile(r"(.)\1+")
OWN, AFTER, BEFORE = (zlib.crc32(f"{place} word ".encode()) for place in ("own", "after", "before"))


@functools.lru_cache(maxsize=100_000)
def _shape_signs(shape: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """Features that a token's shape gives the token itself, the one after it, and the one before."""
    short = REPEATS.sub(r"\1+", shape)[:12]
    kinds = "".join(k for k in "aA0" if k in shape) + ("_" if set(shape) & set("+/_.=-") else "")
    changes = sum(map(str.__ne__, shape, shape[1:]))
    size = min(len(shape).bit_length(), 8)
    own = [f"shape {short}", f"kinds {kinds} {size}", f"changes {min(changes, 12)} {size}", f"size {size}"]
    beside = [f"shape {short}", f"kinds {kinds} {size}"]
    return (
        tuple(map(_number, own)),
        tuple(_number(f"after {x}") for x in beside),
        tuple(_number(f"before {x}") for x in beside),
    )


def _word_signs(token: str) -> tuple[int, int, int]:
    """The word itself as a feature, in the same three places; long tokens count as one word."""
    word = token.lower().encode() if len(token) <= 14 else b"long"
    return tuple(zlib.crc32(word, place) % FEATURES for place in (OWN, AFTER, BEFORE))


def _signs(token: str) -> list[tuple[int, ...]]:
    return [s + (w,) for s, w in zip(_shape_signs(token.translate(SHAPES)), _word_signs(token))]


def _file_signs(text: str) -> tuple[int, ...]:
    """Features of a whole text: how long it is, and how much looks like settings or code."""
    size = len(text) + 1
    marks = sum(map(text.count, "=:")) * 100 // size
    return (
        _number(f"file size {size.bit_length() // 3}"),
        _number(f"file marks {min(marks, 5)}"),
        _number(f"file lines {(text.count(chr(10)) * 500 // size).bit_length()}"),
    )


# -- learning -----------------------------------------------------------------


@dataclass(frozen=True)
class Crf:
    """Weights of each feature for outside, begin, inside; and of each pair of tags in a row."""

    weights: np.ndarray  # FEATURES x 3
    steps: np.ndarray  # 3 x 3


def learn(docs: DataFrame, fit_windows: int = FIT_WINDOWS) -> Crf:
    """A CRF that has learned from the fixed patterns where secrets stand, and not by their names alone.

    Windows of tokens around every match of ``docs(text)``, and around places without
    one, are cut where the text is; a text offers one of its places without a match for
    each ``EVERY`` steps of ``STEP`` characters, on average. Around half of the matches the
    word that names the secret gives way to another word of the window, so that what
    stands in the place of a secret and looks like one is learned too. At most
    ``fit_windows`` of either sort, in the order of a hash, reach the driver and are
    fitted there by conditional likelihood. A task passes on no more than that, and
    copies of a window are one. Features are hashed to FEATURES numbers. Without any
    match the model tags nothing.
    """
    rows = docs.select(text_or_empty().alias("text"))
    schema = "hash bigint, secret boolean, tags array<int>, features array<array<int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, dict[int, tuple]] = {True: {}, False: {}}
        for part in text_slices(batches, "text"):
            for text in part.column("text").to_pylist():
                for window in _windows(text):
                    held[window[1]][window[0]] = window
            for secret, found in held.items():
                if len(found) > 2 * fit_windows:
                    held[secret] = {h: found[h] for h in sorted(found)[:fit_windows]}
        best = [found[h] for found in held.values() for h in sorted(found)[:fit_windows]]
        if best:
            columns = [pa.array(c, t) for c, t in zip(zip(*best), WINDOW_TYPES)]
            yield pa.record_batch(columns, ["hash", "secret", "tags", "features"])

    windows = stored(rows.mapInArrow(cut, schema), "windows").dropDuplicates(["hash", "secret"])
    pick = lambda secret: windows.filter(F.col("secret") == secret).orderBy("hash").limit(fit_windows)
    sample = pick(True).unionAll(pick(False)).toArrow()
    return _fitted(sample.column("tags").to_pylist(), sample.column("features").to_pylist())


WINDOW_TYPES = (pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))
STEP, EVERY = 2048, 64  # where places without a match may be, and how many of them are offered


def _windows(text: str) -> list[tuple]:
    """``hash, secret, tags, features`` of a text's windows; the hash is that of words and tags."""
    spans = base_spans(text)
    file = _file_signs(text)
    places = [m.start(2) if kind == "assign" and (m := ASSIGN.match(text, start)) else start for kind, start, _ in spans]
    values = [(max(start, p), end) for (_, start, end), p in zip(spans, places)]
    offered = [i for i in range(0, len(text), STEP) if zlib.crc32(text[i : i + 64].encode()) % EVERY == 0]
    order = np.argsort([a for a, _ in values], kind="stable").tolist()
    starts = [values[i][0] for i in order]
    furthest = list(itertools.accumulate((values[i][1] for i in order), max))
    out = []
    for place, secret in [(p, True) for p in places] + [(p, False) for p in offered]:
        first = max(0, place - 16 * WINDOW)
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, first, place + 32 * WINDOW)]
        middle = sum(start < place for start, _ in tokens)
        tokens = tokens[max(0, middle - WINDOW) : middle + WINDOW]
        if not tokens:
            continue
        tags, within = [], False
        for start, end in tokens:
            before = bisect.bisect_left(starts, end)  # values that begin before the token ends
            hit = before > 0 and furthest[before - 1] > start
            tags.append((I if within else B) if hit else O)
            within = hit
        words = [text[a:b] for a, b in tokens]
        mark = xxhash.xxh3_64_intdigest(f"{' '.join(words)} {tags}".encode())
        if secret and mark % 2:
            words = _unnamed(words, tags, mark)
        out.append((mark - (mark >> 63 << 64), secret, tags, [list(f) for f in _features(words, file)]))
    return out


NAMES = re.compile(r"(?ai)password|passwd|secret|token|api_?key")


def _unnamed(words: list[str], tags: list[int], mark: int) -> list[str]:
    """The words with another of them in the place of each name of a secret."""
    others = [w for w, tag in zip(words, tags) if tag == O and w[0].isalpha() and not NAMES.search(w)] or ["x"]
    return [others[(mark + i) % len(others)] if tag == O and NAMES.search(w) else w for i, (w, tag) in enumerate(zip(words, tags))]


def _features(words: list[str], file: tuple[int, ...]) -> list[tuple[int, ...]]:
    signs = [_signs(w) for w in words]
    return [
        s[0] + file + (signs[i - 1][1] if i else ()) + (signs[i + 1][2] if i + 1 < len(signs) else ())
        for i, s in enumerate(signs)
    ]


def _fitted(tags: list[list[int]], features: list[list[list[int]]]) -> Crf:
    """Adaptive gradient steps on the conditional log-likelihood, the same on every run."""
    weights, steps = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    if not any(t != O for w in tags for t in w):
        weights[:, O] = 1.0
        return Crf(weights, steps)
    seen_weights, seen_steps = np.full((FEATURES, 3), 1e-2), np.full((3, 3), 1e-2)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(tags))
        for k in range(0, len(shuffled), 64):
            chosen = shuffled[k : k + 64]
            own = [features[i] for i in chosen]
            longest = max(map(len, own))
            filled = np.array([len(w) for w in own])
            truth = np.zeros((len(own), longest), np.int64)
            for row, i in enumerate(chosen):
                truth[row, : filled[row]] = tags[i]
            flat = np.array([f for w in own for t in w for f in t])
            counts = np.array([len(t) for w in own for t in w])
            inside = np.arange(longest) < filled[:, None]
            owner = np.repeat(np.arange(len(counts)), counts)
            scores = np.zeros((len(own), longest, 3))
            scores[inside] = np.stack([np.bincount(owner, weights[flat, y], len(counts)) for y in range(3)], axis=1)
            tag, pair = _chances(scores, steps, inside)
            miss = (np.eye(3)[truth] - tag)[inside]
            both = inside[:, 1:, None, None]
            pairs = np.eye(3)[truth[:, :-1]][..., None] * np.eye(3)[truth[:, 1:]][..., None, :]
            slope = np.stack([np.bincount(flat, miss[owner, y], FEATURES) for y in range(3)], axis=1) - 1e-4 * weights
            step_slope = ((pairs - pair) * both).sum((0, 1)) - 1e-4 * steps
            seen_weights += slope**2
            seen_steps += step_slope**2
            weights += 0.3 * slope / np.sqrt(seen_weights)
            steps += 0.3 * step_slope / np.sqrt(seen_steps)
    return Crf(weights, steps)


def _chances(scores: np.ndarray, steps: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each tag and of each pair of tags, by forward and backward sums."""
    rows, length, _ = scores.shape
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, length):
        into = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + scores[:, t]
        ahead[:, t] = np.where(inside[:, t, None], into, ahead[:, t - 1])
    for t in range(length - 2, -1, -1):
        out = np.logaddexp.reduce(steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(inside[:, t + 1, None], out, 0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None, None]
    tag = np.exp(np.minimum(ahead + behind - total, 0))
    pair = ahead[:, :-1, :, None] + steps + (scores + behind)[:, 1:, None, :] - total[..., None]
    return tag, np.exp(np.minimum(pair, 0))


# -- tagging ------------------------------------------------------------------


class Tagger:
    """Best tags of whole texts, each distinct token's weights added up once."""

    def __init__(self, model: Crf):
        self.model = model
        self.spread = 2 * float(model.steps.max() - model.steps.min())
        self.shapes: dict[str, int] = {}
        self.by_shape = np.zeros((0, 9))

    def _parts(self, tokens: list[str]) -> np.ndarray:
        """Nine sums per token: what it adds to itself, to the next and to the one before."""
        weights = self.model.weights
        shapes = [t.translate(SHAPES) for t in tokens]
        if len(self.shapes) > 200_000:
            self.shapes, self.by_shape = {}, np.zeros((0, 9))
        fresh = [s for s in dict.fromkeys(shapes) if s not in self.shapes]
        if fresh:
            sums = [np.concatenate([weights[list(signs)].sum(0) for signs in _shape_signs(s)]) for s in fresh]
            self.shapes.update(zip(fresh, range(len(self.by_shape), len(self.by_shape) + len(fresh))))
            self.by_shape = np.concatenate([self.by_shape, sums])
        words = np.array([_word_signs(t) for t in tokens], np.int64)
        return self.by_shape[[self.shapes[s] for s in shapes]] + weights[words].reshape(len(tokens), 9)

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Runs of tokens tagged as one secret, per text.

        A token whose outside score leads by more than any change of its two steps can
        make up is outside in the best sequence. Only what lies between such tokens
        needs Viterbi's recursion, and the result is that of the whole text.
        """
        pieces = [TOKEN.findall(t) for t in texts]
        counts = np.array([len(p) for p in pieces], np.int64)
        ends = bounds(counts)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not ends[-1]:
            return out
        words = pa.array([w for p in pieces for w in p], pa.large_string()).dictionary_encode()
        table = self._parts(words.dictionary.to_pylist())
        at = words.indices.to_numpy()
        own, after, before = table[:, :3][at], table[:, 3:6][at], table[:, 6:][at]
        scores = own
        starts, lasts = ends[:-1][counts > 0], ends[1:][counts > 0] - 1
        after[lasts], before[starts] = 0, 0
        scores[1:] += after[:-1]
        scores[:-1] += before[1:]
        file = np.array([self.model.weights[list(_file_signs(t))].sum(0) for t in texts])
        scores += np.repeat(file, counts, axis=0)
        open_ = np.flatnonzero(scores[:, O] - scores[:, 1:].max(1) <= self.spread)
        owner = np.repeat(np.arange(len(texts)), counts)
        apart = np.flatnonzero((np.diff(open_) > 1) | (np.diff(owner[open_]) > 0)) + 1
        placed, starts_of = -1, np.zeros(0, np.int64)
        for run in np.split(open_, apart) if len(open_) else []:
            text = int(owner[run[0]])
            tags = self._viterbi(scores[run], run[0] > ends[text], run[-1] + 1 < ends[text + 1])
            if any(tags):
                if text != placed:  # runs come text by text: each is scanned for places once
                    placed, starts_of = text, np.fromiter((m.start() for m in TOKEN.finditer(texts[text])), np.int64, counts[text])
                first = int(run[0] - ends[text])
                out[text] += _joined(starts_of[first : first + len(tags)].tolist(), pieces[text][first : first + len(tags)], tags)
        return out

    def _viterbi(self, scores: np.ndarray, led: bool, followed: bool) -> list[int]:
        """Best tags of a stretch; ``led`` and ``followed`` tell whether an outside token stands beside."""
        steps = self.model.steps
        best = scores[0] + (steps[O] if led else 0)
        back = []
        for row in scores[1:]:
            ways = best[:, None] + steps
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        if followed:
            best = best + steps[:, O]
        tags = [int(best.argmax())]
        for ways in reversed(back):
            tags.append(int(ways[tags[-1]]))
        return tags[::-1]


def _joined(starts: list[int], tokens: list[str], tags: list[int]) -> list[tuple[str, int, int]]:
    """Tagged tokens as spans: one from each begin, or inside tag after an outside one, to the last inside tag."""
    spans: list[tuple[str, int, int]] = []
    inside = False
    for start, token, tag in zip(starts, tokens, tags):
        if tag == I and inside:
            spans[-1] = ("tagged", spans[-1][1], start + len(token))
        elif tag != O:
            spans.append(("tagged", start, start + len(token)))
        inside = tag != O
    return spans


def merged(base: list[tuple[str, int, int]], tagged: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans, and tagged ones that touch none of them."""
    if not base:
        return in_order(tagged)
    starts = np.array(sorted(s for _, s, _ in base))
    ends = np.array(sorted(e for _, _, e in base))
    # a span is free if all base spans that begin before its end have ended by its start
    free = [t for t in tagged if np.searchsorted(starts, t[2], "left") == np.searchsorted(ends, t[1], "right")]
    return in_order(base + free)


def find_secrets(docs: DataFrame, model: Crf, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns in ``carry``, ``spans`` and ``base_spans`` of ``docs(doc_id, text)``.

    Spans are ``kind, start, end`` in characters, end exclusive, by start, then kind:
    matches of the fixed patterns, and runs of tokens that the CRF tags and that touch
    no match (kind ``tagged``). NULL counts as an empty text and has no spans. Repeated
    rows give the same spans; an empty table gives no rows.
    """
    kept = ["doc_id", *carry]
    rows = docs.select(*kept, text_or_empty().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for part in text_slices(batches, "text"):
            texts = part.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            both = [merged(b, t) for b, t in zip(base, tagger.spans(texts))]
            yield pa.record_batch([*map(part.column, kept), _listed(both), _listed(base)], [*kept, "spans", "base_spans"])

    return rows.mapInArrow(found, f"{schema_of(docs, *kept)}, spans {SPANS}, base_spans {SPANS}")


def _listed(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in spans], pa.list_(kind))


def mask_secrets(docs: DataFrame, model: Crf, mark: str) -> DataFrame:
    """All rows and columns of ``docs``, with every span of ``text`` replaced by ``mark``.

    ``n_chars``, where there is one, is the new length of the texts that changed. NULL
    texts stay NULL.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for part in text_slices(batches, "text"):
            texts = part.column(place).to_pylist()
            plain = [t or "" for t in texts]
            spans = [merged(base_spans(t), found) for t, found in zip(plain, tagger.spans(plain))]
            clean = [redacted(t, s, mark) if s else t for t, s in zip(texts, spans)]
            columns = [pa.array(clean, part.column(place).type) if i == place else part.column(i) for i in range(part.num_columns)]
            if "n_chars" in part.schema.names:
                at = part.schema.names.index("n_chars")
                sizes = [len(t) if s else n for t, s, n in zip(clean, spans, part.column(at).to_pylist())]
                columns[at] = pa.array(sizes, part.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(masked, docs.schema)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every span replaced by ``mark``; spans that overlap become one."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
