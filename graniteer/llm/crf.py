"""Quality of documents from a linear-chain conditional random field over their lines.

Every line of a document is labelled good or bad. A line's features are its own statistics
and those of its neighbours; transitions tie neighbouring labels. Forward-backward gives
each line's marginal, and a document's quality is the mean of the marginals weighted by the
lines' lengths, put through a logistic calibration.

Training: up to `sample` labelled documents (smallest hash first, a bound on what reaches the
driver), whose lines take their document's label at first; after each fit, lines of bad
documents that look good with probability over 0.9 become unlabelled (their label is summed
out), since bad documents have good lines as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import map_batches, reject, text_slices

#: Most labelled documents that are fitted, and most lines of them that the driver holds.
SAMPLE, MAX_LINES = 6_000, 400_000
BASE = 14
N_FEATURES = 3 * BASE + 3


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths in bytes, lines per document) of whole texts; an empty text is one empty line."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lines_of = [r.split(b"\n") for r in raws]
    per_doc = np.array([len(x) for x in lines_of], np.int64)
    buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = (ends - starts).astype(np.float64)
    whole = np.maximum(length, 1.0)

    table = np.zeros((7, 256), np.uint8)
    table[0, 65:91] = 1
    table[1, 97:123] = 1
    for b in b"#*$%&<>^~=_@\\":
        table[2, b] = 1
    table[3, ord("!")] = 1
    table[4, ord("|")] = 1
    table[5, 48:58] = 1
    for b in b".,;:?":
        table[6, b] = 1
    share = np.stack([np.add.reduceat(row[buf].astype(np.int64), starts) for row in table]) / whole

    n = len(ends)
    words, distinct, adjacent, longest, dup = (np.zeros(n) for _ in range(5))
    i = 0
    for lines in lines_of:
        seen: set[bytes] = set()
        for line in lines:
            w = line.split()
            k = len(w)
            if k:
                words[i] = k
                distinct[i] = len(set(w)) / k
                if distinct[i] < 1:
                    adjacent[i] = sum(map(bytes.__eq__, w, w[1:])) / k
                longest[i] = max(map(len, w))
                dup[i] = line in seen
                seen.add(line)
            i += 1
    own = np.empty((n, BASE))
    own[:, :7] = np.sqrt(share.T)
    own[:, 7] = np.log1p(words) / 5
    own[:, 8] = np.where(words > 0, (whole / np.maximum(words, 1)).clip(0, 30) / 10, 0)
    own[:, 9] = np.where(words > 3, distinct, 1)
    own[:, 10] = np.sqrt(adjacent)
    own[:, 11] = dup
    own[:, 12] = longest.clip(0, 60) / 30
    own[:, 13] = words == 0
    first = np.zeros(n, bool)
    heads = np.r_[0, np.cumsum(per_doc)[:-1]]
    first[heads] = True
    last = np.zeros(n, bool)
    last[np.cumsum(per_doc) - 1] = True
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    x[:, 1], x[:, 2] = first, last
    x[:, 3 : 3 + BASE] = own
    x[1:, 3 + BASE : 3 + 2 * BASE] = np.where(first[1:, None], 0, own[:-1])
    x[:-1, 3 + 2 * BASE :] = np.where(last[:-1, None], 0, own[1:])
    return x, length, per_doc


def _steps(per_doc: np.ndarray) -> Iterator[np.ndarray]:
    """Line numbers at each position of the chains, of the documents that are so long."""
    heads = np.r_[0, np.cumsum(per_doc)[:-1]]
    order = np.argsort(-per_doc, kind="stable")
    heads, left = heads[order], per_doc[order]
    for t in range(int(left[0]) if len(left) else 0):
        yield heads[: np.searchsorted(-left, -t, side="left")] + t


def forward_backward(unary: np.ndarray, pair: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals of each line, summed pair marginals, log partition) of two-label chains.

    unary: (lines, 2) log potentials; pair: (2, 2) log potentials of neighbours.
    """
    n = len(unary)
    alpha, beta, scale, p = np.empty((n, 2)), np.ones((n, 2)), np.empty(n), np.exp(pair)
    peak = unary.max(1, keepdims=True)
    u = np.exp(unary - peak)
    steps = list(_steps(per_doc))
    for t, at in enumerate(steps):
        a = u[at] if t == 0 else (alpha[at - 1] @ p) * u[at]
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    for at in reversed(steps[1:]):
        beta[at - 1] = ((beta[at] * u[at]) @ p.T) / scale[at][:, None]
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for at in steps[1:]:
        pairs += np.einsum("ni,ij,nj->ij", alpha[at - 1], p, beta[at] * u[at] / scale[at][:, None])
    return marginal, pairs, float(np.log(scale).sum() + peak.sum())


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    pair: tuple[float, float, float, float]
    slope: float
    offset: float

    def documents(self, texts: list[str | None]) -> np.ndarray:
        x, length, per_doc = line_features(texts)
        return 1 / (1 + np.exp(-(self.slope * self.raw(x, length, per_doc) + self.offset)))

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(probability that each line is good, lines per document)."""
        x, _, per_doc = line_features(texts)
        u = np.zeros((len(x), 2))
        u[:, 1] = x @ np.array(self.weights)
        return forward_backward(u, np.array(self.pair).reshape(2, 2), per_doc)[0][:, 1], per_doc

    def raw(self, x: np.ndarray, length: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        u = np.zeros((len(x), 2))
        u[:, 1] = x @ np.array(self.weights)
        good = forward_backward(u, np.array(self.pair).reshape(2, 2), per_doc)[0][:, 1]
        heads = np.r_[0, np.cumsum(per_doc)[:-1]]
        w = length + 1
        mean = np.add.reduceat(good * w, heads) / np.add.reduceat(w, heads) if len(heads) else np.zeros(0)
        mean = mean.clip(1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))


def fit_chain(x: np.ndarray, per_doc: np.ndarray, label: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials; label: 0, 1 or -1 (unlabelled). Adam on the mean log-likelihood."""
    free = np.zeros((len(x), 2))
    free[label == 0, 1] = -30.0
    free[label == 1, 0] = -30.0
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        u = np.zeros((len(x), 2))
        u[:, 1] = x @ w
        all_m, all_p, _ = forward_backward(u, pair, per_doc)
        own_m, own_p, _ = forward_backward(u + free, pair, per_doc)
        grad = np.r_[x.T @ (own_m - all_m)[:, 1], (own_p - all_p).ravel()] / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def calibrate(raw: np.ndarray, y: np.ndarray, cut: float, balanced: bool = True) -> tuple[float, float]:
    """Slope and offset so that the cut of best accuracy (of both classes alike, if balanced) lies at probability `cut`."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    order = np.argsort(raw, kind="stable")
    r, t = raw[order], y[order]
    bad, good = np.cumsum(t == 0).astype(float), (t.sum() - np.cumsum(t)).astype(float)
    value = bad / (t == 0).sum() + good / t.sum() if balanced else (bad + good) / len(t)
    value[:-1][r[1:] == r[:-1]] = -1
    best = np.flatnonzero(value >= value.max() - 1e-12)
    at = best[len(best) // 2]
    edge = (r[at] + r[at + 1]) / 2 if at + 1 < len(r) else r[at] + 1.0  # all on one side of the cut: a clear step beyond it
    if value.max() < (1.0 if balanced else t.mean()):
        edge = r[0] - 1.0
    spread = max(float(np.percentile(np.abs(raw - edge), 50)), 0.5)
    slope = 3.0 / spread
    return slope, float(np.log(cut / (1 - cut)) - slope * edge)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE, cut: float = 0.3, lines: int = MAX_LINES) -> Model:
    """Fit on up to `sample` rows of labels (doc_id, label) that `usable` admits. Without any, scores are 0.5.

    Documents are taken in the order of their id's hash until `lines` lines are met; one of more lines by itself is passed over. A
    document with several labels counts with the largest; one whose id is repeated, with its first text in order. Null labels, ids
    and texts: the first two take no part, a null text is one empty line.
    """
    held = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    few = held.orderBy(order, "doc_id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n")).join(F.broadcast(few), "doc_id")
    counted = counted.groupBy("doc_id").agg(F.max("n").alias("n")).where(F.col("n") <= lines)
    upto = F.sum("n").over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # `sample` rows at most
    taken = counted.select("doc_id", upto.alias("upto")).where(F.col("upto") <= lines).select("doc_id")
    few = few.join(F.broadcast(taken), "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                x, length, per_doc = line_features(part.column("text").to_pylist())
                cuts = np.cumsum(per_doc)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), pa.array([a.astype(np.float32).tobytes() for a in np.split(x, cuts)]), pa.array([a.astype(np.float32).tobytes() for a in np.split(length, cuts)])],
                    names=["y", "x", "length"],
                )

    got = map_batches(texts, run, "y int, x binary, length binary").toLocalIterator()
    rows = [(r["y"], np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["length"], np.float32)) for r in got]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))  # rows arrive in any order
    if not rows:
        return Model((0.0,) * N_FEATURES, (0.0,) * 4, 1.0, 0.0)
    y = np.array([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows]).astype(np.float64)
    length = np.concatenate([r[2] for r in rows]).astype(np.float64)
    per_doc = np.array([len(r[2]) for r in rows], np.int64)
    given = np.repeat(y, per_doc)
    label_now = given.copy()
    for again in range(2):
        w, pair = fit_chain(x, per_doc, label_now)
        model = Model(tuple(w.tolist()), tuple(pair.ravel().tolist()), 1.0, 0.0)
        if again == 0:
            u = np.zeros((len(x), 2))
            u[:, 1] = x @ w
            label_now = np.where((given == 0) & (u[:, 1] > np.log(9)), -1, given)
    slope, offset = calibrate(model.raw(x, length, per_doc), y, cut)
    return Model(model.weights, model.pair, slope, offset)


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """keep columns and the score (0 to 1) of every row's whole text; null and empty texts are one empty line. keep must not name `out` (ValueError)."""
    reject(df.select(*keep), out)
    held = df.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in held.drop("__text").dtypes] + [f"{out} double"])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "__text", 1 << 20):
                got = model.documents(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(got, pa.float64())], names=[*keep, out])

    return map_batches(held, run, schema)
