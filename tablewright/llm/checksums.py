"""Castagnoli checksums of many byte strings at once, and their masked form."""

from __future__ import annotations

import functools

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, bits reversed
MASK = 0xA282EAD8  # what record files add to a rotated checksum
CHUNK = 1024


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Four tables for a word of four bytes, and four that move a checksum over CHUNK zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    word = [one]
    for _ in range(3):
        word.append(one[word[-1] & 0xFF] ^ (word[-1] >> 8))
    bytewise = np.arange(256, dtype=np.uint32)
    over = []
    for k in range(4):
        state = bytewise << np.uint32(8 * k)
        for _ in range(CHUNK):
            state = one[state & 0xFF] ^ (state >> 8)
        over.append(state)
    return np.array(word), np.array(over)


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksum of each ``data[start : start + length]``, bytes as uint8.

    Strings are cut into chunks from their end, all chunks run through the tables
    side by side, and each string's chunks are then folded in order. The first
    four bytes are inverted instead of starting from all ones; shorter strings
    go byte by byte.
    """
    word, over = _tables()
    out = np.zeros(len(lengths), np.uint32)
    short = np.flatnonzero(lengths < 4)
    for i in short:
        state = 0xFFFFFFFF
        for byte in data[starts[i] : starts[i] + lengths[i]].tolist():
            state = int(word[0][(state ^ byte) & 0xFF]) ^ (state >> 8)
        out[i] = state ^ 0xFFFFFFFF
    rows = np.flatnonzero(lengths >= 4)
    if not len(rows):
        return out
    counts = -(-lengths[rows] // CHUNK)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    lanes = np.zeros((int(firsts[-1]), CHUNK), np.uint8)
    flat = lanes.reshape(-1)
    for k, i in enumerate(rows.tolist()):
        end, n, at = int(firsts[k + 1]) * CHUNK, int(lengths[i]), int(starts[i])
        flat[end - n : end] = data[at : at + n]
        flat[end - n : end - n + 4] ^= 0xFF
    words = np.ascontiguousarray(lanes.view("<u4").T)
    state = np.zeros(words.shape[1], np.uint32)
    for column in words:
        state ^= column
        state = word[3][state & 0xFF] ^ word[2][(state >> 8) & 0xFF] ^ word[1][(state >> 16) & 0xFF] ^ word[0][state >> 24]
    folded = np.zeros(len(rows), np.uint32)
    order = np.argsort(-counts, kind="stable")  # strings with many chunks first
    falling = counts[order]
    for k in range(int(counts.max())):
        live = order[: np.searchsorted(-falling, -k, "left")]
        own = folded[live]
        moved = over[0][own & 0xFF] ^ over[1][(own >> 8) & 0xFF] ^ over[2][(own >> 16) & 0xFF] ^ over[3][own >> 24]
        folded[live] = moved ^ state[firsts[live] + k]
    out[rows] = folded ^ np.uint32(0xFFFFFFFF)
    return out


def masked(checksums: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that files of checksums check well."""
    return ((checksums >> np.uint32(15)) | (checksums << np.uint32(17))) + np.uint32(MASK)
