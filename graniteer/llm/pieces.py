"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The piece file gives pieces with log scores. A text is normalised as such models do without
character maps: each space becomes the marker U+2581 and one marker is put in front. The
best segmentation has the largest sum of scores; ties prefer the segmentation whose last piece starts
earliest. Characters that no piece covers are written as their UTF-8 bytes (pieces <0x00> to <0xFF>).
Decoding joins the pieces, turns byte pieces into text and markers into spaces, and drops the
one in front, so that decode(encode(text)) == text for every text without U+2581.

No piece has a marker after another character, so that Viterbi can run on each
stretch (markers, then other characters) alone; stretches are remembered, within bounds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_batches, reject, text_slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Kinds of pieces in the file: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BYTE_PENALTY = 10.0
MEMO = 400_000
_LONG = 512


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes):
    """(field, value) of a protocol buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            n, at = _varint(raw, at) if kind == 2 else ((4 if kind == 5 else 8), at)
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in the order of ids. Read on the driver alone."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for field, value in _fields(raw):
        if field == 1:
            d = dict(_fields(value))
            out.append((d[1].decode(), float(np.frombuffer(d.get(2, b"\0\0\0\0"), np.float32)[0]), int(d.get(3, NORMAL))))
    return out


@dataclass(frozen=True)
class Trie:
    """Double-array trie: from state s by code c to t = base[s] + c if check[t] == s; value[t] is a piece's id or -1."""

    codes: dict[str, int]
    base: list[int]
    check: list[int]
    value: list[int]

    @staticmethod
    def build(pieces: dict[str, int]) -> Trie:
        codes = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        root: dict = {}
        for p, i in pieces.items():
            node = root
            for c in p:
                node = node.setdefault(codes[c], {})
            node[0] = i
        size, span = 1 << 17, len(codes) + 1
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        free_from, todo = 1, [(0, root)]
        while todo:
            s, node = todo.pop()
            kids = np.array(sorted(k for k in node if k), np.int64)
            if 0 in node:
                value[s] = node[0]
            if not len(kids):
                continue
            b, step, found = max(1, free_from - int(kids[0])), 64, None
            while found is None:
                if b + step + span >= len(check):
                    more = len(check)
                    base, check, value = np.r_[base, np.zeros(more, np.int64)], np.r_[check, np.full(more, -1, np.int64)], np.r_[value, np.full(more, -1, np.int64)]
                fits = np.ones(step, bool)
                for k in kids.tolist():
                    fits &= check[b + k : b + k + step] == -1
                if fits.any():
                    found = b + int(fits.argmax())
                else:
                    b, step = b + step, min(2 * step, 1 << 14)
            base[s] = found
            check[found + kids] = s
            while check[free_from] != -1:
                free_from += 1
            todo += [(found + k, node[k]) for k in kids.tolist()]
        end = int(np.flatnonzero(check != -1).max()) + 1
        return Trie(codes, base[:end].tolist(), check[:end].tolist(), value[:end].tolist())


@dataclass(frozen=True)
class Codec:
    trie: Trie
    scores: list[float]
    texts: list[str]  # by id; empty for controls
    bytes_at: list[int]  # ids of <0x00> to <0xFF>
    byte_of: dict[int, int]
    byte_score: float

    @staticmethod
    def load(path: str = MODEL) -> Codec:
        rows = read_pieces(path)
        byte_of = {i: int(p[3:5], 16) for i, (p, _, k) in enumerate(rows) if k == BYTE}
        bytes_at = [i for i, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        if len(bytes_at) != 256:
            raise ValueError("the piece file has no byte pieces")
        usable = {p: i for i, (p, _, k) in enumerate(rows) if k in (NORMAL, USER)}
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("a piece goes on after a marker")
        low = min((s for _, s, k in rows if k in (NORMAL, USER) and s > -1e8), default=0.0)
        return Codec(Trie.build(usable), [s for _, s, _ in rows], [p if k in (NORMAL, USER) else "" for p, _, k in rows], bytes_at, byte_of, low - BYTE_PENALTY)

    def stretch(self, s: str) -> tuple[int, ...]:
        """Viterbi over one stretch."""
        n = len(s)
        codes, base, check, value, scores = self.trie.codes, self.trie.base, self.trie.check, self.trie.value, self.scores
        top, size = [0.0] + [-np.inf] * n, len(check)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        c = [codes.get(x, 0) for x in s]
        for i in range(n):
            here, state, single = top[i], 0, False
            for j in range(i, n):
                if not c[j]:
                    break
                t = base[state] + c[j]
                if t >= size or check[t] != state:
                    break
                state, v = t, value[t]
                if v >= 0:
                    single |= j == i
                    new = here + scores[v]
                    if new > top[j + 1]:
                        top[j + 1], back[j + 1] = new, (i, v)
            if not single:
                new = here + self.byte_score * len(s[i].encode("utf-8", "surrogatepass"))
                if new > top[i + 1]:
                    top[i + 1], back[i + 1] = new, (i, -1)
        out: list[int] = []
        j = n
        while j:
            i, v = back[j]
            out += [v] if v >= 0 else [self.bytes_at[b] for b in reversed(s[i:j].encode("utf-8", "surrogatepass"))]
            j = i
        return tuple(reversed(out))

    def encode(self, text: str | None, memo: dict[str, tuple[int, ...]]) -> list[int]:
        """Ids of a whole text; null and empty ones have none."""
        if not text:
            return []
        out: list[int] = []
        for s in STRETCH.findall(MARK + text.replace(" ", MARK)):
            got = memo.get(s)
            if got is None:
                got = self.stretch(s)
                if len(s) <= _LONG:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[s] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(bytes((self.byte_of[i],)) if i in self.byte_of else self.texts[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def encode_rows(df: DataFrame, codec: Codec, keep: tuple[str, ...] = ("doc_id",), text: str = "text", check: bool = True) -> DataFrame:
    """keep columns, token_ids (null for a null text), n_tokens and, with check, round_trip (decoding gives the text back).

    keep must not name a column that is added (ValueError); repeated rows are encoded alike.
    """
    reject(df.select(*keep), "token_ids", "n_tokens", "round_trip")
    held = df.select(*keep, F.col(text).cast("string").alias("__text"))
    extra = ["token_ids array<int>", "n_tokens bigint"] + ["round_trip boolean"] * check
    schema = ", ".join([f"`{c}` {t}" for c, t in held.drop("__text").dtypes] + extra)

    def run(batches):
        memo: dict[str, tuple[int, ...]] = {}
        pieces = [(bytes((codec.byte_of[i],)) if i in codec.byte_of else p.encode()) for i, p in enumerate(codec.texts)]
        for batch in batches:
            for part in text_slices(batch, "__text", 1 << 20):
                texts = part.column("__text").to_pylist()
                ids = [None if t is None else codec.encode(t, memo) for t in texts]
                cols = [part.column(c) for c in keep] + [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x or ()) for x in ids], pa.int64())]
                if check:
                    back = (x and b"".join([pieces[i] for i in x]).decode("utf-8", "replace").replace(MARK, " ")[1:] for x in ids)
                    cols.append(pa.array([t is None or (b or "") == t for t, b in zip(texts, back, strict=True)]))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "token_ids", "n_tokens", *["round_trip"] * check])

    return map_batches(held, run, schema)


def decode_rows(df: DataFrame, codec: Codec, keep: tuple[str, ...] = ("doc_id",), ids: str = "token_ids", out: str = "text") -> DataFrame:
    """keep columns and the text of every row's ids; null stays null. keep must not name `out` (ValueError)."""
    reject(df.select(*keep), out)
    held = df.select(*keep, F.col(ids).cast("array<int>").alias("__ids"))
    schema = ", ".join([f"`{c}` {t}" for c, t in held.drop("__ids").dtypes] + [f"`{out}` string"])

    def run(batches):
        for batch in batches:
            got = [None if x is None else codec.decode(x) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(got, pa.string())], names=[*keep, out])

    return map_batches(held, run, schema)
