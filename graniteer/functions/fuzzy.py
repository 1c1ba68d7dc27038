"""Locality-sensitive digests of content after the published TLSH method, by numpy.

The method hashes byte triplets by a fixed permutation of 256 bytes. The permutation is a parameter: give the
published one (256 numbers) to get digests that other tools can compare; the default comes from a rule,
and its digests compare with each other only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the method: salts with the triplets of window places (0: newest byte) that they go with.
TRIPLETS = ((2, 0, 1, 2), (3, 0, 1, 3), (5, 0, 2, 3), (7, 0, 2, 4), (11, 0, 1, 4), (13, 0, 3, 4))
BUCKETS, WINDOW, LEAST = 128, 5, 50


def permutation(seed: str = "graniteer") -> tuple[int, ...]:
    """All byte values, in order of a hash of each."""
    return tuple(sorted(range(256), key=lambda i: hashlib.sha256(f"{seed}{i}".encode()).digest()))


def _length_code(n: int) -> int:
    if n <= 656:
        return math.floor(math.log(n) / math.log(1.5)) & 255
    if n <= 3_199:
        return math.floor(math.log(n) / math.log(1.3) - 8.72777) & 255
    return math.floor(math.log(n) / math.log(1.1) - 62.5472) & 255


def _swapped(x: int) -> int:
    return (x & 15) << 4 | x >> 4


def tlsh(value: bytes, table: tuple[int, ...]) -> str | None:
    """70 hex digits; None for fewer than 50 bytes or too little variety (no upper quartile, half the buckets empty)."""
    if len(value) < LEAST:
        return None
    t, x = np.array(table, np.uint8), np.frombuffer(value, np.uint8)
    at = [x[WINDOW - 1 - k : len(x) - k] for k in range(WINDOW)]
    counts = np.zeros(256, np.int64)
    for salt, a, b, c in TRIPLETS:
        counts += np.bincount(t[t[t[t[salt] ^ at[a]] ^ at[b]] ^ at[c]], minlength=256)
    checksum = 0
    for new, old in zip(at[0].tolist(), at[1].tolist(), strict=True):
        checksum = table[table[table[table[0] ^ new] ^ old] ^ checksum]
    held = counts[:BUCKETS]
    q1, q2, q3 = (int(np.sort(held)[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    if q3 == 0 or np.count_nonzero(held) <= BUCKETS // 2:
        return None
    ratios = (q1 * 100 // q3 % 16) << 4 | q2 * 100 // q3 % 16
    codes = (held > q1).astype(int) + (held > q2) + (held > q3)
    body = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1)[::-1]
    return bytes([_swapped(checksum), _swapped(_length_code(len(value))), ratios, *body.tolist()]).hex()


def distance(a: str, b: str) -> int:
    """How far two digests are: header differences, and steps between the buckets' codes, a full step counting six."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)

    def gap(p: int, q: int, ring: int) -> int:
        return min((p - q) % ring, (q - p) % ring)

    n = gap(_swapped(x[1]), _swapped(y[1]), 256)
    out = n if n <= 1 else n * 12
    for p, q in ((x[2] >> 4, y[2] >> 4), (x[2] & 15, y[2] & 15)):
        d = gap(p, q, 16)
        out += d if d <= 1 else (d - 1) * 12
    out += x[0] != y[0]
    for p, q in zip(x[3:], y[3:], strict=True):
        for k in (0, 2, 4, 6):
            d = abs((p >> k & 3) - (q >> k & 3))
            out += 6 if d == 3 else d
    return out


Hasher = Callable[[bytes, tuple[int, ...]], str | None]
HASHERS: dict[str, Hasher] = {"tlsh": tlsh}


def register(name: str, hasher: Hasher) -> None:
    """Make a digest of one's own known by a lower-case name; plans made afterwards carry the function to the workers."""
    HASHERS[name.lower()] = hasher


def fuzzy_hashes(content: Column, size: Column, least: int = 256, most: int = 20 << 20, table: tuple[int, ...] | None = None, names: tuple[str, ...] = ("tlsh",)) -> Column:
    """map of algorithm to digest for files in the size window (most <= 0: no upper end); null without a digest. Unknown names are left out."""
    table = tuple(table or permutation())
    known = [n for n in dict.fromkeys(x.lower() for x in names) if n in HASHERS]
    if not known:
        return F.lit(None).cast("map<string,string>")
    if sorted(table) != list(range(256)):
        raise ValueError("the table must be a permutation of 0 to 255")
    inside = (size >= least) & ((size <= most) if most > 0 else F.lit(True))

    def column(name: str) -> Column:
        hasher = HASHERS[name]
        run = F.pandas_udf(lambda values: pd.Series([None if v is None else hasher(bytes(v), table) for v in values], dtype=object), "string")
        return run(F.when(inside, content))

    each = F.array(*[F.struct(F.lit(n).alias("k"), column(n).alias("v")) for n in known])
    found = F.filter(each, lambda p: p["v"].isNotNull())
    return F.when(F.size(found) > 0, F.map_from_entries(found))
