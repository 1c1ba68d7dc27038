"""Suffix-array deduplication of repeated byte strings, exact.

A byte goes if a string of WIDTH bytes that covers it also starts in a document with a
smaller id. Texts are UTF-8 bytes; matches never cross documents.

Sorting every suffix of a corpus would shuffle many times its size, so the suffixes sorted are
those at anchors: in each window of WIDTH bytes, the place of the smallest hash of LEAD bytes.
Equal windows have equal anchors at equal places, so windows need to be compared only among suffixes
with the same LEAD leading bytes, and nothing is lost.

1. Texts that are equal as a whole are settled by a hash of the text: all but the
   smallest id go entirely.
2. Anchors' hashes are sent to buckets of hashes, packed (5 bytes each and the documents), to learn which occur in two
   documents. A hash that two documents of one slice share is sent once, which keeps
   hot passages small. Hash collisions only add candidates.
3. Suffixes at the remaining anchors, with the bytes of their windows, are range-partitioned by
   their first WIDTH bytes with splitters from a sample; of equal ones in a slice all but the first
   are settled at once, the first is sent; a document's own repeats are one row. A splitter may cut suffixes with one lead
   apart, and a suffix that fills several buckets of the sample is dealt to as many parts by id, so no lead and no suffix has to
   fit one task.
4. Each bucket sorts its windows by three-way multikey quicksort (8 bytes at a time) and takes the smallest id of every run.
5. Windows whose forward part (from the anchor on) is a prefix of one of the bucket's own splitters may have equals in
   other buckets. Of each such run the smallest id's windows are compared across the boundaries: one more exchange, by the
   window, in which a bucket has one document for each run.

What steps 2 and 4 return is written, and the shuffles that made it are deleted then: the texts' and suffixes' (step 3) are the most
that lies on disk at once, before the texts are shuffled again to meet their ranges.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import map_batches, map_groups, reject, staged, text_slices

WIDTH, LEAD = 50, 20
SPAN = WIDTH - LEAD + 1
_B = 0x9E3779B97F4A7C15
#: Windows hashed at a time, bytes of text in a slice, runs folded at a time; all bound a worker's memory.
_CHUNK, SLICE, _RUNS = 1 << 19, 1 << 20, 1 << 17
#: Text bytes for each hash bucket and each suffix bucket. Splitters sampled for each bucket, documents sampled at least, and the most
#: buckets by range; with more text, each of these is cut further by a hash of the lead.
BUCKET_BYTES, SUFFIX_BYTES, PER_BUCKET, LEAST_DOCS, MOST_RANGES = 10 << 20, 5 << 20, 16, 1_000, 1 << 16
#: Anchors are about so many bytes apart.
SPACING = 16
LOW = np.uint64((1 << 40) - 1)


def _lead_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the LEAD bytes from each place, by doubling."""
    cur, width, out, got, left = buf.astype(np.uint64) + np.uint64(1), 1, None, 0, LEAD
    while left:
        if left & 1:
            if out is None:
                out, got = cur, width
            else:
                n = len(cur) - got
                out, got = out[:n] * np.uint64(pow(_B, width, 1 << 64)) + cur[got : got + n], got + width
        left >>= 1
        if left:
            n = len(cur) - width
            cur, width = cur[:n] * np.uint64(pow(_B, width, 1 << 64)) + cur[width : width + n], 2 * width
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the window from each place: its anchor's place, and the anchor's hash."""
    n = len(buf) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = [], []
    for low in range(0, n, _CHUNK):
        part = buf[low : min(low + _CHUNK, n) + WIDTH - 1]
        h = _lead_hashes(part)
        best, covered = h & ~np.uint64(63), 1
        while covered < SPAN:  # the low bits hold how far right the least hash is
            step = min(covered, SPAN - covered)
            best = np.minimum(best[:-step], best[step:] + np.uint64(step))
            covered += step
        a = np.arange(len(best)) + (best & np.uint64(63)).astype(np.int64)
        at.append(a + low)
        hashes.append(h[a])
    return np.concatenate(at), np.concatenate(hashes)


def anchor_runs(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the concatenated texts: doc number, anchor, its hash, first and last window start of each run of windows with one anchor."""
    size = np.array([len(r) for r in raws], np.int64)
    buf = np.frombuffer(b"".join(raws), np.uint8)
    at, h = window_anchors(buf)
    doc = np.repeat(np.arange(len(raws)), size)[: len(at)]
    starts = np.flatnonzero(np.cumsum(size)[doc] - np.arange(len(at)) >= WIDTH)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none
    a, d = at[starts], doc[starts]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    tail = np.r_[head[1:] - 1, len(a) - 1]
    # Anchors have small hashes: mixed once more, they spread over the buckets.
    key = (h[starts[head]] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x94D049BB133111EB)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(_B)
    return d[head], a[head], key ^ (key >> np.uint64(30)), starts[head], starts[tail]


def multikey_order(columns: list[np.ndarray], small: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their columns, and whether each sorted row opens a new run of equal ones.

    Three-way multikey quicksort: rows under, at and over a pivot; those at it go on with the next column. Parts of `small`
    rows are sorted at once.
    """
    n = len(columns[0])
    order, opens = np.arange(n), np.zeros(n, bool)
    opens[:1] = True
    todo = [(0, n, 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(columns):
            continue
        part = order[low:high]
        if high - low <= small:
            part = part[np.lexsort([c[part] for c in reversed(columns[depth:])])]
            order[low:high] = part
            for c in columns[depth:]:
                v = c[part]
                opens[low + 1 : high] |= v[1:] != v[:-1]
            continue
        v = columns[depth][part]
        few = np.sort(v[:: max(1, len(v) // 255)])
        pivot = few[len(few) // 2]
        under, at = v < pivot, v == pivot
        order[low:high] = np.concatenate([part[under], part[at], part[~(under | at)]])
        first = low + int(under.sum())
        last = first + int(at.sum())
        opens[first] = True
        if last < high:
            opens[last] = True
        todo += [(low, first, depth), (first, last, depth + 1), (last, high, depth)]
    return order, opens


def _pack(key: np.ndarray, doc: np.ndarray) -> bytes:
    """Docs with counts, the low 5 bytes of each hash. Sorted by doc."""
    ids, n = np.unique(doc, return_counts=True)
    short = len(ids) > 0 and int(ids[-1]) - int(ids[0]) < 1 << 32 and n.max() < 1 << 16
    low = np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:])
    own = ((ids - ids[0]).astype(np.uint32), n.astype(np.uint16)) if short else (ids.astype(np.int64), n.astype(np.uint32))
    return b"".join((np.array([len(ids), len(key), short, ids[0]], np.int64).tobytes(), own[0].tobytes(), own[1].tobytes(), low.tobytes()))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    docs, n, short, least = np.frombuffer(raw, np.int64, 4)
    at, (id_kind, n_kind) = 32, (np.uint32, np.uint16) if short else (np.int64, np.uint32)
    ids = np.frombuffer(raw, id_kind, docs, at).astype(np.int64) + (least if short else 0)
    at += ids.size * np.dtype(id_kind).itemsize
    count = np.frombuffer(raw, n_kind, docs, at).astype(np.int64)
    low = np.zeros((n, 8), np.uint8)
    low[:, 3:] = np.frombuffer(raw, np.uint8, 5 * n, at + docs * np.dtype(n_kind).itemsize).reshape(-1, 5)
    return low.view(">u8").ravel().astype(np.uint64), np.repeat(ids, count)


def _by_doc(doc: np.ndarray, key: np.ndarray) -> list[pa.Array]:
    """(id, keys) from loose pairs."""
    order = np.argsort(doc, kind="stable")
    doc, key = doc[order], (key[order] & LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return [pa.array(doc[first].astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), pa.array(key))]


def _shared(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, the first of each hash in it, and whether two documents have that hash."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    return order, first, np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)


def _repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(id, key): hashes of a document's anchors (40 bits) that another document has, too; a row each. docs: (id, text), ids not null."""

    def send(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                ids = part.column("id").to_numpy(zero_copy_only=False)
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                d, _, h, _, _ = anchor_runs(raws)
                if not len(d):
                    continue
                doc = ids[d].astype(np.int64)
                once = np.lexsort((doc, h))  # each hash of a document once, however often it repeats itself
                once = once[np.r_[True, (h[once][1:] != h[once][:-1]) | (doc[once][1:] != doc[once][:-1])]]
                h, doc = h[once], doc[once]
                order, first, many = _shared(h, doc)
                settled = np.zeros(len(h), bool)
                settled[order] = np.repeat(many, np.diff(np.r_[first, len(order)]))
                if settled.any():  # two documents of this slice: known already
                    own = _by_doc(doc[settled], h[settled])
                    mark = pa.array(-1 - (own[0].to_numpy() % buckets), pa.int32())
                    yield pa.RecordBatch.from_arrays([mark, *own, pa.nulls(len(mark), pa.binary())], names=["bucket", "id", "keys", "packed"])
                sent = ~settled
                sent[order[first]] = True  # one of each hash, for other slices
                s = np.flatnonzero(sent)
                s = s[np.argsort(doc[s], kind="stable")]
                b = ((h[s] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                by = np.argsort(b, kind="stable")
                cut = np.flatnonzero(np.r_[True, b[by][1:] != b[by][:-1]])
                rows = [s[x] for x in np.split(by, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[by[cut]], pa.int32()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64())), pa.array([_pack(h[r], doc[r]) for r in rows], pa.binary())],
                    names=["bucket", "id", "keys", "packed"],
                )

    def meet(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            own = table.select(["id", "keys"]).combine_chunks()
            keys = own.column("keys").combine_chunks()
            return pa.table([own.column("id").take(pc.list_parent_indices(keys)), pc.list_flatten(keys)], names=["id", "key"])
        got = [_unpack(x) for x in table.column("packed").to_pylist()]
        h, doc = (np.concatenate([g[i] for g in got]) for i in range(2))
        order, first, many = _shared(h, doc)
        hit = order[np.repeat(many, np.diff(np.r_[first, len(order)]))]
        return pa.table([pa.array(doc[hit], pa.int64()), pa.array((h[hit] & LOW).astype(np.int64))], names=["id", "key"])

    sent = map_batches(docs, send, "bucket int, id long, keys array<long>, packed binary")
    return map_groups(sent, ["bucket"], meet, "id long, key long")


def _splitters(docs: DataFrame, total: int, ranges: int) -> tuple[list[bytes], dict[bytes, int]]:
    """First WIDTH bytes of suffixes that cut the corpus's anchors in about equal parts, and how many parts those fill that fill several.

    From a sample of whole documents by hash, thinned to PER_BUCKET suffixes for each bucket.
    """
    n = max(1, docs.count())
    share = min(1.0, max(LEAST_DOCS / n, PER_BUCKET * SPACING * ranges / max(total, 1)))
    few = docs.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * share))
    stride = max(1, int(share * total / SPACING / (PER_BUCKET * max(ranges, 64))))

    def leads(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                d, a, _, _, _ = anchor_runs(raws)
                ends, whole = np.cumsum([len(r) for r in raws]), b"".join(raws)
                yield pa.RecordBatch.from_arrays([pa.array([whole[i : min(i + WIDTH, ends[j])].ljust(WIDTH, b"\0") for i, j in zip(a[::stride].tolist(), d[::stride].tolist(), strict=True)], pa.binary())], names=["lead"])

    got = sorted(bytes(r["lead"]) for r in map_batches(few, leads, "lead binary").toLocalIterator())
    cuts = Counter(got[len(got) * i // ranges] for i in range(1, ranges)) if got else Counter()
    return sorted(cuts), {c: k + 1 for c, k in cuts.items() if k > 1}


def _folded(buf: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, off: np.ndarray) -> dict[tuple[bytes, int, int], int | list[np.ndarray]]:
    """Starts of the runs with the same bytes and anchor in one document: (bytes, anchor's offset, doc number) to the start, or to arrays of them."""
    out: dict[tuple[bytes, int, int], int | list[np.ndarray]] = {}
    wide = np.concatenate([buf, np.zeros(WIDTH + SPAN, np.uint8)])
    for i in range(0, len(start), _RUNS):
        x, n, o, d = (v[i : i + _RUNS] for v in (start, size, off, doc))
        most = int(n.max())
        held = np.zeros((len(x), most + 8), np.uint8)
        held[:, :most] = wide[x[:, None] + np.arange(most)]
        held[:, :most][np.arange(most) >= n[:, None]] = 0
        held[:, most:] = np.stack([n, o, d >> 24, (d >> 16) & 255, (d >> 8) & 255, d & 255, n, o], 1)
        rows = held.view(np.dtype((np.void, most + 8))).ravel()
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.r_[True, rows[order][1:] != rows[order][:-1]])
        many = np.diff(np.r_[first, len(order)])
        at, whole, wide_row = order[first], held.tobytes(), most + 8
        for f, k, j, xj, nj, oj, dj in zip(first.tolist(), many.tolist(), at.tolist(), x[at].tolist(), n[at].tolist(), o[at].tolist(), d[at].tolist(), strict=True):
            key = (whole[j * wide_row : j * wide_row + nj], oj, dj)
            known = out.get(key)
            if known is None and k == 1:
                out[key] = xj
                continue
            group = x[order[f : f + k]]
            out[key] = [group] if known is None else [*known, group] if isinstance(known, list) else [np.array([known]), group]
    return out


def _suffixes(held: DataFrame, cuts: list[bytes], hot: dict[bytes, int], subs: int, spread: int) -> DataFrame:
    """held: (id, text, keys). Suffixes at candidate anchors: (bucket, sub, id, start, gaps, off, bytes); bucket < 0: settled, [start, off) goes."""
    edges = np.array(cuts, dtype=f"S{WIDTH}")
    names = ["bucket", "sub", "id", "start", "gaps", "off", "bytes"]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                ids = part.column("id").to_pylist()
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                base = np.r_[0, np.cumsum([len(r) for r in raws])]
                low = base.tolist()
                d, a, h, s, e = anchor_runs(raws)
                keys = part.column("keys")
                owner = np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy(zero_copy_only=False))
                wanted = (owner.astype(np.uint64) << np.uint64(40)) | keys.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
                hit = np.flatnonzero(np.isin((d.astype(np.uint64) << np.uint64(40)) | (h & LOW), wanted))
                if not len(hit):
                    continue
                buf = np.frombuffer(b"".join(raws), np.uint8)
                kinds = _folded(buf, d[hit], s[hit], e[hit] - s[hit] + WIDTH, a[hit] - s[hit])
                least: dict[tuple[bytes, int], int] = {}
                for raw, off, di in kinds:
                    if ids[di] < least.get((raw, off), ids[di] + 1):
                        least[raw, off] = ids[di]
                gone: dict[int, list[tuple[int, int]]] = {}
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                lead = []
                for (raw, off, di), found in kinds.items():
                    if isinstance(found, int):
                        first, gaps, at = found - low[di], b"", None
                    else:
                        at = np.sort(np.concatenate(found)) - low[di]
                        first, gaps = int(at[0]), np.diff(at).astype(np.uint32).tobytes()
                    if ids[di] > least[raw, off]:
                        gone.setdefault(di, []).extend([(first, first + len(raw))] if at is None else merged_ranges(np.stack([at, at + len(raw)], 1)))
                        continue
                    suffix = raws[di][first + off : first + off + WIDTH].ljust(WIDTH, b"\0")
                    if suffix in hot:
                        sub = ids[di] % hot[suffix]
                    else:
                        sub = int.from_bytes(hashlib.blake2b(suffix[:LEAD], digest_size=4).digest(), "big") % subs if subs > 1 else 0
                    lead.append(suffix)
                    for col, v in zip(out, (0, sub, ids[di], first, gaps, off, raw), strict=True):
                        col.append(v)
                if lead:
                    out = (np.searchsorted(edges, np.array(lead, dtype=f"S{WIDTH}"), side="right").tolist(), *out[1:])
                for di, spans in gone.items():
                    for x, y in merged_ranges(np.array(spans, np.int64)):
                        for col, v in zip(out, (-1 - ids[di] % spread, 0, ids[di], x, None, y, None), strict=True):
                            col.append(v)
                kinds_of = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds_of, strict=True)], names=names)

    return map_batches(held, run, "bucket int, sub int, id long, start long, gaps binary, off long, bytes binary")


def sorted_bucket(ids: list[int], offs: list[int], parts: list[bytes], low_cut: bytes, high_cut: bytes) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each suffix with its windows' bytes: byte ranges that go, and the windows that are the bucket's first but may have equals in another bucket.

    The cuts are the bucket's own splitters, empty at the ends.
    """
    kinds: dict[tuple[bytes, int], int] = {}
    leads: dict[bytes, list[int]] = {}
    kind_of, least, touch = [], [], []
    for doc, off, raw in zip(ids, offs, parts, strict=True):
        key = (raw, off)
        k = kinds.get(key)
        if k is None:
            k = kinds[key] = len(least)
            least.append(doc)
            lead = raw[off : off + LEAD]
            leads.setdefault(lead, []).append(k)
            same = max((len(os.path.commonprefix([raw[off : off + WIDTH], c])) for c in (low_cut, high_cut) if c[:LEAD] == lead), default=0)
            touch.append(min(max(0, off - WIDTH + same + 1), len(raw) - WIDTH + 1))
        elif doc < least[k]:
            least[k] = doc
        kind_of.append(k)
    keys = list(kinds)
    unsettled = [(i, k) for i, ks in enumerate(leads.values()) if len(ks) > 1 for k in ks]
    mins: dict[int, np.ndarray] = {}
    if unsettled:
        group = np.array([i for i, _ in unsettled], np.int64)
        which = [k for _, k in unsettled]
        raws = [keys[k][0] for k in which]
        size = np.array([len(r) for r in raws], np.int64)
        base = np.r_[0, np.cumsum(size)[:-1]]
        buf = np.frombuffer(b"".join(raws) + bytes(8), np.uint8).astype(np.uint64)
        word = np.zeros(len(buf) - 7, np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | buf[i : len(buf) - 7 + i]
        n = size - WIDTH + 1
        row = np.repeat(np.arange(len(which)), n)
        inside = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        at = base[row] + inside
        shift = np.array([keys[k][1] for k in which], np.int64)[row] - inside
        columns = [((group[row] << 6) | shift).astype(np.uint64)] + [word[at + j] for j in (*range(0, WIDTH - 8, 8), WIDTH - 8)]
        order, opens = multikey_order(columns)
        first = np.flatnonzero(opens)
        doc = np.array([least[k] for k in which], np.int64)[row]
        low = np.empty(len(row), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(order)]))
        mins = dict(zip(which, np.split(low, np.cumsum(n)[:-1]), strict=True))
    out = []
    for doc, k, raw in zip(ids, kind_of, parts, strict=True):
        spans, mine = [], []
        if doc > least[k]:
            spans = [(0, len(raw))]
        else:
            gone = mins[k] < doc if k in mins else np.zeros(len(raw) - WIDTH + 1, bool)
            at = np.flatnonzero(gone)
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                spans = list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + WIDTH).tolist(), strict=True))
            mine = np.flatnonzero(~gone[: touch[k]]).tolist()
        out.append((spans, mine))
    return out


def starts_of(start: int, gaps: bytes) -> np.ndarray:
    return start + np.r_[0, np.cumsum(np.frombuffer(gaps, np.uint32).astype(np.int64))]


def merged_ranges(spans: np.ndarray) -> list[tuple[int, int]]:
    """Rows (from, to): sorted, disjoint, not touching."""
    if len(spans) == 1:
        return [tuple(spans[0].tolist())]
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return list(zip(spans[head, 0].tolist(), reach[np.r_[head[1:] - 1, len(spans) - 1]].tolist(), strict=True))


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(id, spans): byte ranges that go, of each document that has some. texts: (id, text, ...), ids not null."""
    keyed = texts.select("id", F.octet_length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("key")).where(f"n >= {WIDTH}")
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "first")
    # Written first, so that both sides of the join are plain shuffles, whose skewed parts are split.
    copies = staged(keyed.join(staged(first, "first-copies", True), "key").where("id > first").select("id", "n"), "copies", True)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    buckets, parts = max(8, total // BUCKET_BYTES), max(12, total // SUFFIX_BYTES)
    ranges = min(parts, MOST_RANGES)
    hits = staged(_repeated_anchors(texts.select("id", "text"), buckets), "anchors", True)
    both = hits.withColumn("copy", F.lit(0)).union(copies.select("id", F.lit(None).cast("long"), F.lit(1)))
    keys = both.groupBy("id").agg(F.collect_list("key").alias("keys"), F.max("copy").alias("copy")).where("copy = 0").drop("copy")
    cuts, hot = _splitters(texts, total, ranges)
    suffixes = _suffixes(texts.join(keys, "id"), cuts, hot, max(1, parts // ranges), parts)
    names = ["id", "x", "y", "win", "gaps"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def settle(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        if b < 0:
            none = pa.nulls(len(table), pa.binary())
            return pa.table([table.column("id"), table.column("start"), table.column("off"), none, none], names=names)
        ids, offs, raws, starts, gaps = (table.column(c).to_pylist() for c in ("id", "off", "bytes", "start", "gaps"))
        found = sorted_bucket(ids, offs, raws, cuts[b - 1] if b else b"", cuts[b] if b < len(cuts) else b"")
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, raw, start, gap, (spans, mine) in zip(ids, raws, starts, gaps, found, strict=True):
            if not gap:
                rows = [(doc, start + x, start + y, None, None) for x, y in spans]
            else:
                at = starts_of(start, gap)
                rows = [(doc, x, y, None, None) for x, y in merged_ranges(np.concatenate([np.stack([at + x, at + y], 1) for x, y in spans]))] if spans else []
            rows += [(doc, start + x, None, raw[x : x + WIDTH], gap) for x in mine]
            for r in rows:
                for col, v in zip(out, r, strict=True):
                    col.append(v)
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    settled = staged(map_groups(suffixes, ["bucket", "sub"], settle, "id long, x long, y long, win binary, gaps binary"), "settled", True)
    # Across boundaries: a bucket has one document for each window here.
    open_ = settled.where("win is not null").withColumn("first", F.min("id").over(Window.partitionBy("win"))).where("id > first")

    def spell(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for doc, x, gap in zip(*(batch.column(c).to_pylist() for c in ("id", "x", "gaps")), strict=True):
                at = starts_of(x, gap)
                for low, high in merged_ranges(np.stack([at, at + WIDTH], 1)):
                    for col, v in zip(out, (doc, low, high), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "x", "y"])

    crossing = map_batches(open_.select("id", "x", "gaps"), spell, "id long, x long, y long")
    spans = settled.where("win is null").select("id", "x", "y").union(crossing).union(copies.select("id", F.lit(0).cast("long"), "n"))
    return spans.groupBy("id").agg(F.collect_list(F.struct("x", "y")).alias("spans"))


def dedup(df: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, keep columns, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row.

    kept_text drops what is left of characters cut by a range's edge; kept_sha256 is of all bytes left. A null
    text counts as empty (kept_text stays null); a row without an id takes no part; rows that repeat an id are one
    document and are not each other's copies; an empty table gives an empty result. keep must not name a column that is added (ValueError).
    """
    reject(df.select(*keep), "id", "spans", id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    # No alias where none is needed: it would keep the two exchanges of the texts from being one.
    own = F.col("text") if text == "text" and dict(df.dtypes)["text"] == "string" else F.col(text).cast("string").alias("text")
    docs = df.select(*keep, F.col(id_col).cast("long").alias("id"), own)
    # The texts meet their places, then their ranges, by one and the same exchange.
    texts = docs.where("id is not null")
    kept = texts.join(repeated_ranges(texts), "id", "left").select("id", *keep, "text", "spans")
    kept = kept.unionByName(docs.where("id is null"), allowMissingColumns=True)
    schema = ", ".join(["id long"] + [f"`{c}` {t}" for c, t in kept.select(*keep).dtypes] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "kept_text string"])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                n, gone, spans_n, sha, left = [], [], [], [], []
                spans_of = part.column("spans").to_pylist()
                for t, s in zip(part.column("text").to_pylist(), spans_of, strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    m = merged_ranges(np.array([(x["x"], x["y"]) for x in s], np.int64)) if s else []
                    rest = b"".join(raw[x:y] for x, y in zip([0] + [y for _, y in m], [x for x, _ in m] + [len(raw)], strict=True))
                    n.append(len(raw))
                    gone.append(len(raw) - len(rest))
                    spans_n.append(len(m))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    left.append(None if t is None else rest.decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(part.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_n, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())],
                    names=["id", *keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return map_batches(kept, run, schema).withColumnRenamed("id", id_col)
