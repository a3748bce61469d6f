"""Byte-level BPE: merges picked from the root of a segment tree over pair ranks."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import bounds, ragged, schema_of, text_or_empty, text_slices
from tablewright.llm.token_ids import byte_letters

# the tokenizer family's fixed rule for cutting a text into words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_WORDS, MAX_IDS = 600_000, 4_000_000  # that a task remembers
BLOCK_BYTES = 1 << 20  # of words, each filled up to its width, whose trees stand side by side
LONG = 256  # bytes; longer words have a tree of their own
NEVER = np.int64(1) << 62


class Bpe:
    """Encoder and decoder of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, before = rules["model"], rules["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or rules["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        vocabulary = model["vocab"]
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.byte_ids = np.array([vocabulary[letter] for letter in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocabulary[m[side]] for m in merges], np.int64) for side in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], NEVER)
        self.ranks = dict(zip(keys.tolist(), range(len(keys))))
        self.special = {a["content"]: a["id"] for a in rules.get("added_tokens", [])}
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.words = regex.compile(WORDS)
        spelled = {i: token for token, i in vocabulary.items()} | {i: token for token, i in self.special.items()}
        table = [
            bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
            for token in (spelled.get(i, "") for i in range(max(spelled) + 1))
        ]
        self.spelling_lengths = np.array([len(t) for t in table], np.int64)
        self.spelling = np.frombuffer(b"".join(table), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)

    # -- encoding -------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the bounds of each text's ids."""
        if len(self.known) > MAX_WORDS or len(self.flat) > MAX_IDS:
            self._forget()
        words, counts = [], []
        for text in texts:
            before, at = len(words), 0
            for special in self.cut.finditer(text):
                words += self.words.findall(text, at, special.start())
                words.append((self.special[special[0]],))
                at = special.end()
            words += self.words.findall(text, at) if at else self.words.findall(text)
            counts.append(len(words) - before)
        known = self.known
        found = list(map(known.get, words))
        fresh = list(dict.fromkeys(w for w, index in zip(words, found) if index is None))
        if fresh:
            self._learn(fresh)
            found = [known[w] if index is None else index for w, index in zip(words, found)]
        at = np.array(found, np.int64)
        sizes = self.lengths[at]
        return self.flat[ragged(bounds(self.lengths)[at], sizes)], bounds(sizes)[bounds(np.array(counts, np.int64))]

    def _learn(self, words: list) -> None:
        """Encodes new words, those of about one size together."""
        raw = [w.encode() if isinstance(w, str) else b"" for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        encoded: list[np.ndarray | None] = [None] * len(words)
        width = 1
        while width <= LONG:
            rows = np.flatnonzero((sizes > width // 2) & (sizes <= width))
            step = max(BLOCK_BYTES // width, 1)
            for k in range(0, len(rows), step):
                chosen = rows[k : k + step]
                ids, ends = self._merge_many([raw[i] for i in chosen], width)
                for i, a, b in zip(chosen.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    encoded[i] = ids[a:b]
            width *= 2
        for i in np.flatnonzero(sizes > LONG):
            encoded[i] = self._merge_one(raw[i])
        for i in np.flatnonzero(sizes == 0):
            encoded[i] = np.array(words[i], np.int64)
        first = len(self.lengths)
        self.known.update(zip(words, range(first, first + len(words))))
        self.lengths = np.concatenate([self.lengths, np.array([len(e) for e in encoded], np.int64)])
        self.flat = np.concatenate([self.flat, *encoded])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where it has none or an end is missing (-1)."""
        keys = np.where((left >= 0) & (right >= 0), left << 32 | right, 0)
        at = np.searchsorted(self.keys, keys)
        hit = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.order[np.minimum(at, len(self.order) - 1)], NEVER)

    def _merge_many(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most ``width`` bytes, one tree each, all trees of one shape.

        A leaf holds ``rank * width + position`` of the pair that starts there, an inner
        node the smaller of its two, so the root is the leftmost pair of lowest rank.
        """
        count = len(words)
        symbols = np.full((count, width + 1), -1, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        inside = np.arange(width + 1) < sizes[:, None]
        symbols[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        tree = np.full((count, 2 * width), NEVER, np.int64)
        leaves = self._rank(symbols[:, :-1], symbols[:, 1:])
        tree[:, width:] = np.where(leaves == NEVER, NEVER, leaves * width + np.arange(width))
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.arange(count)

        def put(live: np.ndarray, position: np.ndarray, rank: np.ndarray) -> None:
            node = position + width
            tree[live, node] = np.where(rank == NEVER, NEVER, rank * width + position)
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])

        while True:
            rows = rows[tree[rows, 1] < NEVER] if width > 1 else rows[:0]
            if not len(rows):
                break
            best = tree[rows, 1]
            at, rank = best % width, best // width
            gone = after[rows, at]
            behind, ahead = after[rows, gone], before[rows, at]
            symbols[rows, at] = self.merged[rank]
            symbols[rows, gone] = -1
            after[rows, at] = behind
            inner = behind <= width
            before[rows[inner], behind[inner]] = at[inner]
            follower = np.where(inner, symbols[rows, np.minimum(behind, width)], -1)
            put(rows, gone, np.full(len(rows), NEVER))
            put(rows, at, self._rank(self.merged[rank], follower))
            has = ahead >= 0
            if has.any():
                put(rows[has], ahead[has], self._rank(symbols[rows[has], ahead[has]], self.merged[rank][has]))
        alive = symbols >= 0
        return symbols[alive], bounds(alive.sum(1))

    def _merge_one(self, word: bytes) -> np.ndarray:
        """One long word with a tree of its own."""
        size = len(word)
        width = 1 << (size - 1).bit_length()
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        ranks, merged, never = self.ranks, self.merged.tolist(), int(NEVER)

        def leaf(at: int, follower: int) -> int:
            rank = ranks.get(symbols[at] << 32 | symbols[follower]) if follower < size else None
            return never if rank is None else rank * width + at

        tree = [never] * (2 * width)
        for at in range(size - 1):
            tree[width + at] = leaf(at, at + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                low = tree[2 * node] if tree[2 * node] < tree[2 * node + 1] else tree[2 * node + 1]
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < never:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            symbols[at], symbols[gone] = merged[rank], -1
            after[at] = after[gone]
            if after[gone] < size:
                before[after[gone]] = at
            put(gone, never)
            put(at, leaf(at, after[at]))
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return np.array([s for s in symbols if s >= 0], np.int64)

    # -- decoding -------------------------------------------------------------

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's bytes as UTF-8; what is no UTF-8 becomes the replacement character."""
        sizes = self.spelling_lengths[ids]
        data = self.spelling[ragged(bounds(self.spelling_lengths)[ids], sizes)].tobytes()
        cuts = bounds(sizes)[ends].tolist()
        return [_valid(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def _valid(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """The worker's tables of this file."""
    return Bpe(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` (4 bytes each, little-endian) of every whole text of ``docs(doc_id, text)``.

    NULL counts as empty and gives no ids. Rows come back one by one as they are,
    repeated ones too; other columns are not looked at.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            ids, ends = bpe(tokenizer).encode(part.column("text").to_pylist())
            yield pa.record_batch([part.column("doc_id"), _packed(ids, ends)], ["doc_id", "ids"])

    return rows.mapInArrow(encoded, f"{schema_of(docs, 'doc_id')}, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; NULL ids give an empty text."""
    rows = encoded.select("doc_id", "ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "ids"):
            raw = [v or b"" for v in part.column("ids").to_pylist()]
            texts = bpe(tokenizer).decode(np.frombuffer(b"".join(raw), "<u4"), bounds(np.array([len(r) // 4 for r in raw])))
            yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(decoded, f"{schema_of(encoded, 'doc_id')}, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: both directions in one pass, digests only.

    NULLs and repeated rows as in ``encode_documents``.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = f"{schema_of(docs, 'doc_id')}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            ids, ends = bpe(tokenizer).encode(part.column("text").to_pylist())
            texts = bpe(tokenizer).decode(ids, ends)
            columns = [
                part.column("doc_id"),
                pa.array(np.diff(ends)),
                pa.array([hashlib.sha256(v).hexdigest() for v in _packed(ids, ends).to_pylist()]),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(passed, schema)


def _packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, buffers).cast(pa.binary())
