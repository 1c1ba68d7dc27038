"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct word shingles. Documents of equal sets (by SHA-256 of the whole sorted set) are one class,
represented by its smallest id; only representatives are compared. Their MinHash signatures are
cut into bands; two representatives that agree in a band are candidates. Candidates are compared
in batches of signature rows: as soon as the posterior probability (uniform prior) that the
similarity reaches the threshold falls under `miss`, the pair is pruned. Survivors are
verified on their full sets.

Within a band's bucket no list of all pairs is made. First every member is compared with
the bucket's smallest member, which joins most of a group of copies in one component. A bucket that still
holds several components belongs to the arena of its largest one, where each member of
another component (a stray) is compared with all of the arena on full sets: an arena and its
strays are dealt in blocks of bounded size, and every block of strays meets every block of the arena. There, too, signatures are
compared in batches and pruned by the posterior, survivors are verified on full sets, most alike first, and a stray is
done with a component at its first link; only these links come out. So no link between components is lost to the shortcut.

With BANDS bands of ROWS rows, a pair at similarity 0.8 shares no band with probability
(1 - 0.8**6)**50 < 3e-7.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import map_batches, map_groups, staged, text_slices

#: Shingles in a block of an arena.
ARENA_SHINGLES = 300_000
BANDS, ROWS, SHINGLE, PERCENT, MISS, BATCH = 50, 6, 5, 80, 1e-7, 30
_M = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> set[bytes]:
    """Distinct shingles of a whole text, words joined by a space; fewer words than width make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return set()
    if len(words) < width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


_WORDS: dict[bytes, int] = {}


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """A 64-bit hash of each distinct shingle, sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    ids = []
    for w in words:
        got = _WORDS.get(w)
        if got is None:
            got = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(got)
    h = np.array(ids, np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    a = np.full(n, width, np.uint64)
    for i in range(width):
        a = _mix(a * _M + h[i : n + i])
    return np.unique(a)


def signature(a: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """32-bit MinHash signature of a set of 64-bit hashes."""
    x = (a >> np.uint64(32)).astype(np.uint32) ^ a.astype(np.uint32)
    best = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    mul, add = seeds[:, 0], seeds[:, 1]
    for i in range(0, len(x), 2048):
        y = x[i : i + 2048, None] * mul[None, :] + add[None, :]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        best = np.minimum(best, y.min(0))
    return best


def seeds(n: int) -> np.ndarray:
    r = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _M).astype(np.uint32).reshape(n, 2)
    r[:, 0] |= 1
    return r


def limits(rows: int, percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> list[int]:
    """After each batch of n rows: with fewer agreeing rows than this, P(similarity >= threshold) < miss.

    The posterior after m of n agreements is Beta(m + 1, n - m + 1); its upper tail at t is the lower tail of a binomial of n + 1 draws.
    """
    out, t = [], percent / 100
    for n in list(range(batch, rows, batch)) + [rows]:
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def profiles(df: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, set_key (SHA-256 of the whole set; null for an empty one), sig (16 bits of each row), bands (64-bit keys)."""
    held = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("__text"))

    def run(batches):
        own = seeds(BANDS * ROWS)
        number = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for part in text_slices(batch, "__text"):
                n, keys, sigs, bands = [], [], [], []
                for t in part.column("__text").to_pylist():
                    whole = shingle_set(t, width)
                    n.append(len(whole))
                    if not whole:
                        keys.append(None)
                        sigs.append(None)
                        bands.append(None)
                        continue
                    keys.append(hashlib.sha256(b"\n".join(sorted(whole))).digest())
                    s = signature(shingle_hashes(t, width), own)
                    sigs.append(s.astype(np.uint16).tobytes())  # enough to compare; bands are of all 32 bits
                    key = number.copy()
                    for c in s.reshape(BANDS, ROWS).T:
                        key = _mix(key * _M + c.astype(np.uint64))
                    bands.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "set_key", "sig", "bands"],
                )

    return map_batches(held, run, "id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def cuts_of(percent: int) -> list[tuple[int, int]]:
    """Signature rows compared after each batch, and the least agreement to go on with."""
    return list(zip([*range(BATCH, BANDS * ROWS, BATCH), BANDS * ROWS], limits(BANDS * ROWS, percent), strict=True))


def verify(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: pruned on signatures, then checked on full sets.

    sigs: (id, sig), one row per id; texts: (id, text), one row per id.
    """
    of = lambda x: sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    cuts = cuts_of(percent)

    def prune(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive, agree, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in cuts:
                agree[alive] += (x[alive, done:n] == y[alive, done:n]).sum(1)
                alive, done = alive[agree[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    alive = staged(map_batches(both, prune, "a long, b long"), "survivors")
    text_of = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    whole = alive.join(text_of("a"), "a").join(text_of("b"), "b")

    def exact(batches):
        held: dict[str, set[bytes]] = {}
        for batch in batches:
            keep = []
            for i, (s, t) in enumerate(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
                x, y = shingle_set(s, width), held.get(t)
                if y is None:
                    held.clear()
                    y = held[t] = shingle_set(t, width)
                inner = len(x & y)
                if inner and 100 * inner >= percent * (len(x) + len(y) - inner):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return staged(map_batches(whole, exact, "a long, b long"), "verified")


def dealt(mixed: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(arena, block, ask_block, id, c, sig, text, asks): each block of an arena with each block of its strays. reps: (id, n, sig)."""
    heads = mixed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.min(F.struct(-F.col("m"), "c"))["c"].alias("arena"))
    placed = mixed.join(staged(heads, "heads"), "key").select("arena", "id", "c").distinct()
    placed = staged(placed.join(reps, "id"), "arenas")
    bounded = lambda n: F.greatest(F.ceil(F.coalesce(F.sum(n), F.lit(0)) / ARENA_SHINGLES), F.lit(1)).cast("int")
    blocks = placed.groupBy("arena").agg(bounded(F.col("n")).alias("blocks"), bounded(F.when(F.col("c") != F.col("arena"), F.col("n"))).alias("ask_blocks"))
    held = placed.join(staged(blocks, "blocks"), "arena").join(texts, "id")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(name)
    targets = held.select("arena", own("blocks", "block"), every("ask_blocks", "ask_block"), "id", "c", "sig", "text", F.lit(False).alias("asks"))
    strays = held.where("c <> arena").select("arena", every("blocks", "block"), own("ask_blocks", "ask_block"), "id", "c", "sig", "text", F.lit(True).alias("asks"))
    return targets.union(strays)


def arena_links(mixed: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components, one at least of each two that have any. mixed: (key, id, c) of buckets with several components; reps: (id, n, sig)."""
    cuts = cuts_of(percent)

    def match(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        out: tuple[list[int], list[int]] = ([], [])
        mine, others = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        if len(mine) and len(others):
            ids, comps = mine.column("id").to_numpy(), mine.column("c").to_numpy()
            rows = lambda t: np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(t), -1)
            x, y = rows(mine), rows(others)
            sets: dict[int, set[bytes]] = {}
            for i in range(len(others)):
                doc, comp = others.column("id")[i].as_py(), others.column("c")[i].as_py()
                alive, done = np.flatnonzero(comps != comp), 0
                agree = np.zeros(len(ids), np.int64)
                for n, least in cuts:
                    agree[alive] += (x[alive, done:n] == y[i, done:n]).sum(1)
                    alive, done = alive[agree[alive] >= least], n
                if not len(alive):
                    continue
                own, linked = shingle_set(others.column("text")[i].as_py(), width), set()
                for j in alive[np.lexsort((ids[alive], -agree[alive]))].tolist():
                    if comps[j] in linked:
                        continue
                    if j not in sets:
                        sets[j] = shingle_set(mine.column("text")[j].as_py(), width)
                    both = len(own & sets[j])
                    if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                        linked.add(comps[j])
                        out[0].append(max(doc, int(ids[j])))
                        out[1].append(min(doc, int(ids[j])))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return staged(map_groups(dealt(mixed, reps, texts), ["arena", "block", "ask_block"], match, "a long, b long"), "arena-links")


def near_duplicates(df: DataFrame, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable) for every row with an id.

    Null and empty texts have no shingles and no links; rows that repeat an id are given the same
    component, and must repeat its text; rows with a null id come back with a null component. Other columns of df are not
    read, so their names do not matter; an empty table gives an empty result.
    """
    prof = staged(profiles(df, width, id_col, text), "minhash")
    full = prof.where("set_key is not null and id is not null")
    classes = staged(full.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    members = full.select("id", "set_key").join(classes, "set_key").select("id", "rep")
    reps = staged(full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n_shingles", "sig", "bands").dropDuplicates(["id"]), "representatives")
    sigs = reps.select("id", "sig")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    keyed = reps.select("id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    hubs = staged(hubs, "hubs")  # so that both sides of the join are plain shuffles, whose skewed parts are split
    shared = staged(keyed.join(hubs, "key"), "shared-bands")
    candidates = shared.select("id").distinct()
    texts = staged(docs.join(candidates, "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")
    stars = shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = verify(stars, sigs, texts, width, percent)
    comp = components(links)
    # Members of one bucket that are in different components still have to be compared.
    named = shared.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    named = staged(named, "named")
    several = staged(named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "several")
    mixed = staged(named.join(several, "key"), "mixed")
    more = arena_links(mixed, reps.select("id", F.col("n_shingles").alias("n"), "sig"), texts, width, percent)
    if more.take(1):
        comp = staged(components(links.union(more)), "components")
    rep_comp = comp.select(F.col("id").alias("rep"), "component")
    found = members.join(rep_comp, "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    found = found.groupBy("id").agg(F.min("component_id").alias("component_id"))
    return prof.select("id", "n_shingles").join(found, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
