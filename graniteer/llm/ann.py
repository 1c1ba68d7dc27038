"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is built and cut into partitions of equal size
(recursive spectral bisection at the median). Softmax regression learns the partitions of a vector's
neighbourhood; it places every vector of the table in its most probable partition, and sends a query to its several most
probable ones, where all vectors are reranked by exact cosine. The number of
partitions probed is the least that finds RECALL of the sample's neighbours.

Neighbouring partitions share a bin, to which a query goes once with the list of those it probes there. Bins and large partitions are cut into
blocks of candidates and blocks of the queries sent there, both of bounded size, and every block of queries meets every block of candidates, so
that many copies of one vector, or many queries for one partition, do not meet in one task. The router is fitted by one task, in slices of CELLS
numbers, so its memory follows the sample, not the sample times the sample or the partitions; the driver gets its weights only.
Vectors are scaled by powers of two before anything is squared, so no norm over- or underflows and scores are those of the originals.
Vectors of another length than the sample's usual one are compared among themselves, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import map_batches, map_groups, staged

#: Least and most vectors fitted (the sample grows with the partitions wanted; the most bounds what reaches the fitting task), graph degree,
#: vectors a partition should hold, candidates and queries of a block, share of the sample's neighbours to be found, sample rows a partition needs.
SAMPLE, MOST, DEGREE, PART_ROWS, BLOCK_ROWS, QUERY_ROWS, RECALL, PER_PART = 4_096, 65_536, 10, 1_500, 32_000, 16_000, 0.96, 32
#: Bytes of a block's vectors (fewer rows, where they are long) and of the sample beyond SAMPLE rows; numbers in a slice of work; rows of a fitting step.
BLOCK_BYTES, SAMPLE_BYTES, CELLS, STEP_ROWS = 16 << 20, 64 << 20, 1 << 21, 8_192


@dataclass(frozen=True)
class Router:
    w: np.ndarray
    b: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        """x: rows as `scaled` gives them."""
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return x @ self.w + self.b

    @property
    def parts(self) -> int:
        return len(self.b)


def slices(n: int, width: int) -> list[slice]:
    """0 to n in slices whose rows of `width` numbers stay within CELLS."""
    step = max(1, CELLS // max(1, width))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest of each row (not itself), in slices and single precision."""
    x, out = x.astype(np.float32), np.empty((len(x), k), np.int64)
    for at in slices(len(x), len(x)):
        s = x[at] @ x.T
        s[np.arange(len(s)), np.arange(at.start, at.stop)] = -np.inf
        np.negative(s, out=s)
        out[at] = np.argpartition(s, min(k, s.shape[1] - 1), axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """Recursive bisection of the neighbour graph; halves differ by one vertex at most."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(7)
    width = 1
    while width < parts:
        inner = label[a] == label[b]
        x, y = a[inner], b[inner]
        degree = np.bincount(x, minlength=n) + 1e-9
        v = rng.standard_normal((n, 4))
        size = np.bincount(label, minlength=width)
        for _ in range(60):  # power iteration on the lazy walk, orthogonal to constants, in all parts at once
            v = 0.5 * v + 0.5 * np.stack([np.bincount(x, v[y, j], n) for j in range(v.shape[1])], 1) / degree[:, None]
            v -= np.stack([np.bincount(label, v[:, j], width) for j in range(v.shape[1])], 1)[label] / size[label, None]
            v /= np.sqrt(np.stack([np.bincount(label, v[:, j] ** 2, width) for j in range(v.shape[1])], 1) + 1e-30)[label]
        order = np.lexsort((np.arange(n), v[:, 0], label))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        rank -= np.r_[0, np.cumsum(size)[:-1]][label]
        label = label * 2 + (rank >= (size[label] + 1) // 2)
        width *= 2
    return label


def train(x: np.ndarray, at: np.ndarray, parts: int, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by Adam; a row's target is shared evenly by the partitions in its row of `at`. A step takes STEP_ROWS rows in turn (all, if no more)."""
    x = x.astype(np.float32)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m, v = [0 * w, 0 * b], [0 * w, 0 * b]
    order = np.random.default_rng(7).permutation(len(x)) if len(x) > STEP_ROWS else np.arange(len(x))
    for step in range(1, rounds + 1):
        rows = order.take(np.arange(min(len(x), STEP_ROWS)) + (step - 1) * STEP_ROWS * (len(x) > STEP_ROWS), mode="wrap")
        g = [decay * w, 0 * b]
        for few in slices(len(rows), parts):
            own = rows[few]
            d = x[own] @ w.astype(np.float32) + b.astype(np.float32)
            d -= d.max(1, keepdims=True)
            np.exp(d, out=d)
            d *= 1 / d.sum(1, keepdims=True)
            for j in range(at.shape[1]):
                d[np.arange(len(own)), at[own, j]] -= np.float32(1 / at.shape[1])
            g[0] += x[own].T @ d / len(rows)
            g[1] += d.sum(0, dtype=np.float64) / len(rows)
        for i, p in enumerate((w, b)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            p -= 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w, b


def valid(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector can take part, as (id, v array<double>, or array<float> where it is one): no nulls, finite, not zero."""
    v = F.col(vec).cast("array<float>" if dict(df.dtypes)[vec] == "array<float>" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.withColumn("v", v).where(v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two that brings their largest component under 1: exact, and squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if x.size else x


def matrix(column) -> np.ndarray:
    """Vectors of one length as rows that are `scaled`."""
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def sampled(vectors: DataFrame, dim: int, held: int, few: int) -> DataFrame:
    """The first `few` of the `held` vectors of length dim in order of their ids' hash, as (v); none of them pass through the driver."""
    key = F.xxhash64("id", F.lit(1))
    usual = vectors.where(F.size("v") == dim).select(key.alias("h"), "id", "v")
    first = lambda df: staged(df.orderBy("h", "id", "v").limit(few).select("v"), "ann-sample")
    if 2 * few < held:
        out = first(usual.where(F.col("h") < -(1 << 63) + (1 << 64) * 2 * few // held))  # twice as many as asked for, unless ids repeat
        if out.count() == few:
            return out
    return first(usual)


def fit(vectors: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Router | None:
    """vectors: (id, v). None for an empty table."""
    lengths = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each length
    if not lengths:
        return None
    total, dim = sum(lengths.values()), min(lengths, key=lambda d: (-lengths[d], d))
    few = min(max(sample, PER_PART * 2 * total // PART_ROWS), most, max(sample, SAMPLE_BYTES // (8 * dim)))

    def learn(batches):
        net = router(np.concatenate([matrix(b.column("v")) for b in batches if b.num_rows]), total)
        yield pa.RecordBatch.from_arrays([pa.array([net.w.tobytes()]), pa.array([net.b.tobytes()]), pa.array([net.probes], pa.int32())], names=["w", "b", "probes"])

    (r,) = map_batches(sampled(vectors, dim, lengths[dim], few).coalesce(1), learn, "w binary, b binary, probes int").collect()
    return Router(np.frombuffer(r["w"]).reshape(dim, -1), np.frombuffer(r["b"]), r["probes"])


def router(x: np.ndarray, total: int) -> Router:
    """x: a sample's rows as `scaled` gives them, of a table of so many."""
    dim = x.shape[1]
    x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    parts = 2
    while parts * PART_ROWS < total and parts * 2 * PER_PART <= len(x):
        parts *= 2
    if len(x) < 4 * parts:
        return Router(np.zeros((dim, 1)), np.zeros(1), 1)
    near = neighbours(x, min(DEGREE, len(x) - 1))
    # A vector's target: the partitions of itself and its neighbours.
    label = balanced_parts(near, parts)
    net = Router(*train(x, np.c_[label, label[near]], parts), 1)
    cuts = slices(len(x), parts)
    placed = np.concatenate([net.logits(x[at]).argmax(1) for at in cuts])
    # At what place of a vector's list its neighbours' partitions are.
    counts = np.zeros(parts, np.int64)
    for at in cuts:
        ranked = np.argsort(-net.logits(x[at]), axis=1)
        place = np.empty_like(ranked)
        np.put_along_axis(place, ranked, np.arange(parts)[None, :], 1)
        counts += np.bincount(np.take_along_axis(place, placed[near[at]], 1).ravel(), minlength=parts)
    reach = np.cumsum(counts) / near.size
    return Router(net.w, net.b, 1 + int(np.argmax(reach >= RECALL)))


def block_rows(most: int, dim: int) -> int:
    """Rows of a block: `most`, or as many as BLOCK_BYTES hold."""
    return max(1, min(most, BLOCK_BYTES // (8 * dim)))


def binned(size: np.ndarray, most: int) -> np.ndarray:
    """A bin for each partition: neighbours share one while they hold `most` rows at most."""
    out, held, at = np.zeros(len(size), np.int64), 0, 0
    for p, n in enumerate(size.tolist()):
        if held and held + n > most:
            held, at = 0, at + 1
        out[p] = at
        held += n
    return out


def least_of_best(near: np.ndarray, k: int) -> np.ndarray:
    """For each row a number that k of its entries reach at least, and few more: the k-th of the maxima of runs of 64."""
    whole = near.shape[1] // 64 * 64
    tops = near if whole < 64 * k else np.concatenate([near[:, :whole].reshape(len(near), -1, 64).max(2), near[:, whole:]], 1)
    return np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] > k else np.full(len(near), -np.inf)


def rerank(table: pa.Table, k: int) -> pa.Table:
    """A block: candidates (id, v, part) and queries (id, v, probed). Each query's k nearest among the candidates of the partitions it probes."""
    asks = table.column("probed").combine_chunks()
    asked = asks.is_valid().to_numpy(zero_copy_only=False)
    ids, v = table.column("id").to_numpy(), table.column("v").combine_chunks()
    c_at, q_at = np.flatnonzero(~asked), np.flatnonzero(asked)
    out: tuple[list, list, list] = ([], [], [])
    kinds = np.array([], np.int64)
    if len(c_at) and len(q_at):
        part = table.column("part").to_numpy()[c_at]
        c_at = c_at[np.argsort(part, kind="stable")]
        kinds, of = np.unique(np.sort(part).astype(np.int64), return_inverse=True)
        c, c_ids, q, q_ids = matrix(v.take(pa.array(c_at))), ids[c_at], matrix(v.take(pa.array(q_at))), ids[q_at]
        norm, q_norm = np.sqrt(np.add.reduce(c * c, axis=1)), np.sqrt(np.add.reduce(q * q, axis=1))
        unit = c / norm[:, None]
        lists = asks.take(pa.array(q_at))
        row, flat = np.repeat(np.arange(len(q_at)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        spot = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
        probes = np.zeros((len(q_at), len(kinds)), bool)
        here = kinds[spot] == flat
        probes[row[here], spot[here]] = True
        order = np.argsort(probes.argmax(1), kind="stable")  # queries of the same partitions go together
        own = np.isin(q_ids, c_ids)
    for i in range(0, len(q_at) if len(kinds) else 0, 128):
        few = order[i : i + 128]
        some = probes[few].any(0)
        cols = np.flatnonzero(some[of])
        if not len(cols):
            continue
        near = (q[few] / q_norm[few, None]) @ (unit if some.all() else unit[cols]).T
        if not probes[few][:, some].all():
            near[~probes[few][:, of[cols]]] = -np.inf
        for j in np.flatnonzero(own[few]):
            near[j, c_ids[cols] == q_ids[few[j]]] = -np.inf
        edge = least_of_best(near, k) - 1e-9
        for j, at in enumerate(few):
            hit = cols[np.flatnonzero((near[j] >= edge[j]) & (near[j] > -np.inf))]
            score = np.add.reduce(c[hit] * q[at], axis=1) / (norm[hit] * q_norm[at])
            top = np.lexsort((c_ids[hit], -score))[:k]
            out[0].extend([int(q_ids[at])] * len(top))
            out[1].extend(c_ids[hit][top].tolist())
            out[2].extend(score[top].tolist())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, router: Router, k: int = 5) -> DataFrame:
    """vectors, queries: (id, v). Returns query_id, rank from 1, vec_id, score: the k nearest found, a query's own id left out."""
    spark, dim, kind = vectors.sparkSession, router.w.shape[0], dict(vectors.dtypes)["v"]

    def of_length(batch, names, fn, last):
        """The usual length's rows by fn; the others with -length as their partition, and what `last` makes of it."""
        size = batch.column("size").to_numpy()
        usual = batch.filter(pa.array(size == dim))
        for at in slices(usual.num_rows, router.parts):
            yield fn(usual.slice(at.start, at.stop - at.start))
        other = batch.filter(pa.array(size != dim))
        if other.num_rows:
            part = -other.column("size").to_numpy()
            yield pa.RecordBatch.from_arrays([other.column("id"), other.column("v"), pa.array(part, pa.int32()), *last(part)], names=names)

    def place(batches):
        names = ["id", "v", "part"]
        one = lambda b: pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(router.logits(matrix(b.column("v"))).argmax(1), pa.int32())], names=names)
        for batch in batches:
            yield from of_length(batch, names, one, lambda part: [])

    sized = lambda df: df.select("id", "v", F.size("v").alias("size"))
    index = staged(map_batches(sized(vectors), place, f"id long, v {kind}, part int"), "index")
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition and odd length
    size = np.array([held.get(p, 0) for p in range(router.parts)])
    bins = binned(size, block_rows(BLOCK_ROWS, dim))

    def route(batches):
        names = ["id", "v", "bin", "probed"]

        def one(batch):
            order = np.argsort(-router.logits(matrix(batch.column("v"))), axis=1)
            need = np.maximum(router.probes, 1 + (np.cumsum(size[order], axis=1) <= k).sum(1))
            chosen = np.zeros(order.shape, bool)
            np.put_along_axis(chosen, order, np.arange(order.shape[1])[None, :] < need[:, None], 1)
            row, part = np.nonzero(chosen & (size > 0))  # bins grow with partitions
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bins[part[1:]] != bins[part[:-1]])][: len(row)])
            probed = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(part, pa.int32()))
            at = pa.array(row[first])
            return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(bins[part[first]], pa.int32()), probed], names=names)

        for batch in batches:
            yield from of_length(batch, names, one, lambda part: [pa.array([[p] for p in part.tolist()], pa.list_(pa.int32()))])

    asked = staged(map_batches(sized(queries), route, f"id long, v {kind}, bin int, probed array<int>"), "routed")
    asks = {r["bin"]: r["m"] for r in asked.groupBy("bin").agg(F.count(F.lit(1)).alias("m")).collect()}  # a number for each bin and odd length
    in_bin: dict[int, int] = {}
    for p, n in held.items():
        at = int(bins[p]) if p >= 0 else p
        in_bin[at] = in_bin.get(at, 0) + n
    dealt = {b: tuple(-(-x // block_rows(y, dim if b >= 0 else -b)) for x, y in ((in_bin[b], BLOCK_ROWS), (m, QUERY_ROWS))) for b, m in asks.items() if b in in_bin}
    table = lambda rows, schema, name: staged(spark.createDataFrame(rows, schema).coalesce(1), name)
    by_bin = table([(b, *n) for b, n in dealt.items()], "bin int, blocks int, ask_blocks int", "ann-bins")
    by_part = table([(p, b, *dealt[b]) for p in held if (b := int(bins[p]) if p >= 0 else p) in dealt], "part int, bin int, blocks int, ask_blocks int", "ann-parts")
    every = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
    own = lambda c, name: F.pmod(F.xxhash64("id", "v"), F.col(c)).cast("int").alias(name)
    mine = index.join(by_part, "part").select("id", "v", "bin", own("blocks", "block"), every("ask_blocks", "ask_block"), "part", F.lit(None).cast("array<int>").alias("probed"))
    others = asked.join(by_bin, "bin").select("id", "v", "bin", every("blocks", "block"), own("ask_blocks", "ask_block"), F.lit(None).cast("int").alias("part"), "probed")
    found = map_groups(mine.union(others), ["bin", "block", "ask_block"], lambda t: rerank(t, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all other rows.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors are
    compared with those of their own length. A query whose id is repeated asks with its least vector, and all rows of that id are
    its own; other repeated rows are candidates each. Equal scores go to the smaller id. An empty table gives an empty result;
    other columns are not read.
    """
    held = valid(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec)).where("id is not null"), vec).select("id", "v")
    net = fit(held)
    if net is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(held, held.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), net, k)
