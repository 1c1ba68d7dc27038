"""BLAKE3-256 by numpy: the chunks of a whole Arrow batch are compressed side by side, as is each level of their trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
CHUNK, BLOCK = 1_024, 64
#: Chunks that are compressed together, so that memory does not grow with a value's length.
LANES = 8_192


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv [n, 8] and words [n, 16], uint32: the first eight output words of each lane."""
    n = len(cv)
    v = [cv[:, i].copy() for i in range(8)] + [np.full(n, x, np.uint32) for x in IV[:4]]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [words[:, i] for i in range(16)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(QUARTERS):
            for word, first, second in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turn(v[d] ^ v[a], first)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], second)
        m = [m[i] for i in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def _leaves(data: np.ndarray, lengths: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """data [n, 1024] bytes, zero-padded: each chunk's chaining value, or root output where the chunk is alone."""
    words = data.view("<u4").reshape(len(data), 16, 16)
    cv = np.tile(np.array(IV, np.uint32), (len(data), 1))
    blocks = np.maximum(1, -(-lengths // BLOCK))
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = np.where(last, CHUNK_END, 0) | (CHUNK_START if b == 0 else 0) | np.where(last & alone[on], ROOT, 0)
        cv[on] = compress(cv[on], words[on, b], counter[on], np.minimum(BLOCK, lengths[on] - b * BLOCK), flags)
    return cv


def digests(values: list[bytes]) -> list[str]:
    if not values:
        return []
    counts = np.array([max(1, -(-len(v) // CHUNK)) for v in values])
    owner = np.repeat(np.arange(len(values)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    cvs = np.empty((len(owner), 8), np.uint32)
    for lo in range(0, len(owner), LANES):
        some = slice(lo, lo + LANES)
        parts = [values[o][p * CHUNK : (p + 1) * CHUNK] for o, p in zip(owner[some], place[some], strict=True)]
        data = np.frombuffer(b"".join(x.ljust(CHUNK, b"\0") for x in parts), np.uint8).reshape(-1, CHUNK)
        cvs[some] = _leaves(data, np.array([len(x) for x in parts]), place[some].astype(np.uint64), counts[owner[some]] == 1)
    while counts.max() > 1:  # neighbours pair up; an odd last node goes up as it is
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < counts[owner]))
        flags = np.where(counts[owner[left]] == 2, PARENT | ROOT, PARENT)
        n = len(left)
        cvs[left] = compress(np.tile(np.array(IV, np.uint32), (n, 1)), np.hstack([cvs[left], cvs[left + 1]]), np.zeros(n, np.uint64), np.full(n, BLOCK), flags)
        stay = place % 2 == 0
        cvs, owner, place, counts = cvs[stay], owner[stay], place[stay] // 2, -(-counts // 2)
    return [row.astype("<u4").tobytes().hex() for row in cvs]


def blake3(content: Column) -> Column:
    """Hex digest of binary content; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        held = values[values.notna()]
        return pd.Series(digests([bytes(v) for v in held]), index=held.index, dtype=object).reindex(values.index)

    return run(content.cast("binary"))
