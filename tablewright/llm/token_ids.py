"""Token ids of whole texts by a tokenizer file, each distinct word encoded once per worker."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tablewright.llm.shared import bounds, ragged

MAX_WORDS = 1_000_000
MAX_IDS = 8_000_000
SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# what the tokenizer's pattern cuts off besides runs of letters
MARKS = rf"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^{SPACES}\pL\pN]+)"
# texts with letters or spaces beyond common Latin, with controls that end words for
# Arrow alone, or with what may be a special token
ODD = r"[^\x{00}-\x{1b}\x{20}-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"
CONTROLS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves; the other bytes, in order,
    get the letters from U+0100.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(visible)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class TextEncoder:
    """``tokenizers`` over texts, with a bounded memory of words.

    A tokenizer whose rules drop white space and look at nothing beyond it gives
    a text's ids word by word. Any other tokenizer encodes text by text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_word = _drops_spaces(rules)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): s for b, s in enumerate(byte_letters())})
        self.forget()

    def forget(self) -> None:
        """Drops the words kept so far, and their ids."""
        self.known: dict[str, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the bounds of each text's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            return _joined([e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)])
        if len(self.known) > MAX_WORDS or len(self.flat) > MAX_IDS:
            self.forget()
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._common(texts)
        ids, ends = self._common(texts.filter(~odd))
        parts, common, rare = [], 0, iter(texts.filter(odd).to_pylist())
        for strange in odd.tolist():
            if strange:
                parts.append(self._rare(next(rare)))
            else:
                parts.append(ids[ends[common] : ends[common + 1]])
                common += 1
        return _joined(parts)

    def _common(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts of common letters: cut into pieces by the file's own rules, column by column."""
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), MARKS, r" \1 ")
        split = pc.ascii_split_whitespace(apart)
        words = split.flatten().dictionary_encode()
        at = self._indices(words.dictionary.to_pylist(), self._piece)[words.indices.to_numpy()]
        sizes = self.lengths[at]
        ids = self.flat[ragged(bounds(self.lengths)[at], sizes)]
        return ids, bounds(sizes)[split.offsets.to_numpy()]

    def _rare(self, text: str) -> np.ndarray:
        """Any text; the library sees every distinct word of it."""
        if CONTROLS.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        whole = lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
        at = self._indices([f" {w}" for w in text.split()], whole)
        return self.flat[ragged(bounds(self.lengths)[at], self.lengths[at])]

    def _indices(self, words: list[str], encode: Callable[[str], list[int]]) -> np.ndarray:
        """Where the ids of each word are kept; words not known yet are encoded."""
        known, lengths, ids = self.known, [], []
        before = len(self.lengths)
        found = list(map(known.get, words))
        for i, index in enumerate(found):
            if index is None:
                word = words[i]
                found[i] = known.get(word)
                if found[i] is None:
                    own = encode(word)
                    found[i] = known[word] = before + len(lengths)
                    lengths.append(len(own))
                    ids += own
        if lengths:
            self.lengths = np.concatenate([self.lengths, np.array(lengths, np.int64)])
            self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        return np.array(found, np.int64)

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece, which the library's model merges as it is."""
        if not piece:
            return []
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(piece)]


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    whole = [np.zeros(0, np.uint32), *[np.asarray(p, np.uint32) for p in parts]]
    return np.concatenate(whole), bounds(np.array([len(p) for p in parts], np.int64))


def _drops_spaces(rules: dict) -> bool:
    """Whether the file lower-cases, joins white space, and drops it between words."""
    normal = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    before = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"] == {"Regex": pattern}
        and not (before[1]["add_prefix_space"] or before[1]["use_regex"])
        and not any(a["lstrip"] or a["rstrip"] or not a["content"].startswith("<|") or " " in a["content"] for a in rules["added_tokens"])
        and rules["model"]["type"] == "BPE"
    )


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """The worker's encoder of this file."""
    return TextEncoder(path)
