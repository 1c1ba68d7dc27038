"""Toxicity by weak supervision.

Voters are lexicon groups (entries with one beginning, found once, twice, or three times and more) and patterns, each of which
says toxic or abstains. A generative label model estimates from the votes how often each voter speaks on toxic and on clean
texts and which voters depend on each other: given the class, the voters form a forest in which a voter's rates depend on
its parent's vote. Expectation-maximisation over labelled and unlabelled documents fits rates and forest in turn; edges are those whose
conditional mutual information pays for their parameters EDGE times over (Bayesian information criterion; class mixtures look like
weak dependence), in a maximum spanning forest. Given labels are a prior on the voters' rates (GIVEN rows each), never
votes: a document's posterior follows from its votes alone. A linear classifier over the lexicon's features is trained on the
posterior labels, and scores all documents.

Labels choose the lexicon's entries, too (words and word beginnings that are far more frequent in toxic documents, by odds and
likelihood ratio), and set the cut of the scores. At most `sample` labelled and as many unlabelled documents
(smallest hash first) and `lexicon` entries are used; these bound what reaches the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import map_batches, reject, staged, text_slices

SAMPLE, LEXICON = 12_000, 1_024
#: A lexicon entry's least log odds and likelihood ratio; weight of a labelled row in the voters' rates; how many times an edge has to pay.
ODDS, RATIO, GIVEN, EDGE = 3.0, 20.0, 10.0, 10.0
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Address in the second person, shouting marks, marks that stand for letters left out.
PATTERNS = (re.compile(r"\byou(?:'re|\s+are|\s+re)\b"), re.compile(r"!{3,}"), re.compile(r"[^\W\d_][*#@$%]{2,}"))


def parts(w: str) -> tuple[str, ...]:
    """A word (as =word) and its beginnings."""
    return ("=" + w, *(w[:k] for k in PREFIXES if len(w) > k))


def tokens(text: str | None) -> set[str]:
    """Words and word beginnings of a text, and those found often as 2token and 3token."""
    count: Counter[str] = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for x in parts(w):
            count[x] += n
    return {c for x, n in count.items() for c in (x, "2" + x, "3" + x)[:n]}


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: tuple[float, ...]  # bias, patterns, then one per lexicon entry
    slope: float
    offset: float

    def score(self, texts: list[str | None], memo: dict[str, tuple[str, ...]]) -> np.ndarray:
        w = np.array(self.weights)
        raw = np.array([w[0] + sum(w[i] for i in hits(t, self.index, memo)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -50, 50)))


def hits(text: str | None, index: dict[str, int], memo: dict[str, tuple[str, ...]]) -> list[int]:
    """Feature numbers of a text: patterns and lexicon entries that it has. memo: of words, bounded."""
    low = (text or "").lower()
    if len(memo) > 300_000:
        memo.clear()
    found: set[int] = set()
    count: Counter[str] = Counter()
    for w, n in Counter(WORD.findall(low)).items():
        got = memo.get(w)
        if got is None:
            got = tuple(x for x in parts(w) if x in index or "2" + x in index or "3" + x in index)
            memo[w] = got
        for x in got:
            count[x] += n
    for x, n in count.items():
        found.update(index[c] for c in (x, "2" + x, "3" + x)[:n] if c in index)
    found.update(1 + i for i, p in enumerate(PATTERNS) if p.search(low))
    return sorted(found)


@dataclass(frozen=True)
class LabelModel:
    """Class balance, each voter's parent (-1: none), log rates by (voter, class, parent's vote, own vote)."""

    prior: float
    parent: np.ndarray
    log_rate: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for each row of a 0/1 matrix of votes."""
        own = votes.astype(np.int64)
        above = np.where(self.parent >= 0, own[:, self.parent], 0)
        j = np.arange(votes.shape[1])
        gain = sum(self.log_rate[j, 1, above, own].T - self.log_rate[j, 0, above, own].T) if len(j) else np.zeros(len(own))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + gain, -40, 40)))


def forest(votes: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Parents of the voters: a maximum spanning forest of the pairs that depend on each other given the class.

    toxic, clean: how many documents with each row's votes are in either class.
    """
    k = votes.shape[1]
    gain = np.zeros((k, k))
    for w in (toxic, clean):
        total = w.sum() + 1e-9
        one = (votes * w[:, None]).sum(0) / total
        both = (votes * w[:, None]).T @ votes / total
        for joint, a, b in ((both, one, one), (one[:, None] - both, one, 1 - one), (one[None] - both, 1 - one, one), (1 - one[:, None] - one[None] + both, 1 - one, 1 - one)):
            joint = np.clip(joint, 1e-12, None)
            gain += total * joint * np.log(joint / np.clip(a[:, None] * b[None], 1e-12, None))
    gain -= EDGE * np.log(max(toxic.sum() + clean.sum(), 2))  # two more parameters, half a log each, EDGE times over
    np.fill_diagonal(gain, 0)
    parent, inside, best, via = np.full(k, -1), np.zeros(k, bool), np.zeros(k), np.full(k, -1)
    for _ in range(k):
        at = int(np.where(inside, -1, best).argmax())
        inside[at], parent[at] = True, via[at]
        better = ~inside & (gain[at] > best)
        best[better], via[better] = gain[at][better], at
    return parent


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 60, every: int = 10) -> tuple[LabelModel, np.ndarray]:
    """The model fitted to a 0/1 matrix of votes (voters in columns), and the posterior of each row from its votes.

    known: 1 or 0 where a label was given, else -1. Given labels count in the voters' rates, as a prior on their accuracies; they
    are no votes, and a row's posterior never looks at its own. Start: half of a vote is toxic, within the given labels' balance.
    Rows with the same votes are fitted as one, with their number.
    """
    own, inverse = np.unique(votes.astype(np.int64), axis=0, return_inverse=True)
    inverse = inverse.ravel()
    given_t, given_c, free = (np.bincount(inverse, known == x, len(own)) for x in (1, 0, -1))
    n, k = len(votes), votes.shape[1]
    p = 1 - 0.5 ** own.sum(1)
    mass = (p * np.bincount(inverse, minlength=len(own))).sum()
    p *= min(1.0, given_t.sum() / max(given_t.sum() + given_c.sum(), 1) * n / max(mass, 1e-9))
    parent = np.full(k, -1)
    model = LabelModel(0.5, parent, np.zeros((k, 2, 2, 2)))
    for r in range(rounds):
        toxic, clean = free * p, free * (1 - p)
        if r and r % every == 0:
            parent = forest(own, toxic + given_t, clean + given_c)
        above = np.where(parent >= 0, own[:, parent], 0)
        rate = np.zeros((k, 2, 2, 2))
        for c, w in enumerate((clean + GIVEN * given_c, toxic + GIVEN * given_t)):
            base = ((own * w[:, None]).sum(0) + 0.1) / (w.sum() + 0.2)
            for u in (0, 1):
                here = (above == u) * w[:, None]
                # A voter's rate under either vote of its parent leans on its rate in the class.
                rate[:, c, u, 1] = ((here * own).sum(0) + base) / (here.sum(0) + 1)
        rate[..., 0] = 1 - rate[..., 1]
        model = LabelModel(float(((toxic + given_t).sum() / max(n, 1)).clip(0.001, 0.999)), parent, np.log(np.clip(rate, 1e-9, 1)))
        p = model.posterior(own)
    return model, p[inverse]


def fit_linear(rows: list[list[int]], target: np.ndarray, n: int, rounds: int = 400, ridge: float = 2e-4) -> np.ndarray:
    """Logistic regression on sparse 0/1 features with soft targets; feature 0 is the bias."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for step in range(1, rounds + 1):
        z = np.bincount(at, w[col], len(rows)) + w[0]
        e = target - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.bincount(col, e[at], n) / len(rows)
        grad[0] += e.mean()
        grad -= ridge * np.r_[0, w[1:]]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON, cut: float = 0.7) -> Model:
    """Fit on up to `sample` rows of labels (doc_id, label) that `usable` admits, and as many of docs without a label.

    A document with several labels counts with the largest; one whose id is repeated, with its first text in order. Null
    labels and ids take no part. Where no entry tells the classes apart (labels of one class, say, or none), every text scores 0.5.
    """
    from .crf import calibrate

    held = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    few = held.orderBy(order, "doc_id").limit(sample)
    bare = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id").join(held, "doc_id", "left_anti").orderBy(order, "doc_id").limit(sample)
    few = few.union(bare.distinct().select("doc_id", F.lit(-1)))
    # At most 2 * sample rows of two numbers.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = staged(texts, "toxicity-sample")

    def mine(batches):
        for batch in batches:
            for part in text_slices(batch):
                for y, t in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                    got = sorted(tokens(t))
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([y] * len(got), pa.int32())], names=["token", "y"])

    known = texts.where("y >= 0")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n_t, n_c = int(total["t"]), int(total["n"]) - int(total["t"])
    order: list[str] = []
    if n_t and n_c:
        counts = map_batches(known, mine, "token string, y int").groupBy("token").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
        odds = F.log((F.col("t") + 0.5) / (n_t + 1.0)) - F.log((F.col("c") + 0.5) / (n_c + 1.0))
        term = lambda o, e: F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)
        both, all_ = F.col("t") + F.col("c"), float(n_t + n_c)
        ratio = term(F.col("t"), both * n_t / all_) + term(F.col("c"), both * n_c / all_) + term(n_t - F.col("t"), (all_ - both) * n_t / all_) + term(n_c - F.col("c"), (all_ - both) * n_c / all_)
        best = counts.where((odds > ODDS) & (ratio > RATIO)).select("token", "t", (F.round(odds * F.sqrt("t"), 6)).alias("s"))
        order = [r["token"] for r in best.orderBy(F.desc("s"), "token").limit(lexicon).collect()]
    index = {w: 1 + len(PATTERNS) + i for i, w in enumerate(order)}
    n_features = 1 + len(PATTERNS) + len(index)

    def features(batches):
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in text_slices(batch):
                rows = [hits(t, index, memo) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(rows, pa.list_(pa.int32()))], names=["y", "f"])

    got = sorted((r["y"], list(r["f"])) for r in map_batches(texts, features, "y int, f array<int>").collect())
    if not order:  # nothing tells the classes apart
        return Model(index, (0.0,) * n_features, 1.0, 0.0)
    y, rows = np.array([r[0] for r in got]), [r[1] for r in got]
    # Voters: the patterns, and the entries with one beginning and number.
    group: dict[str, int] = {}
    voter = {index[w]: len(PATTERNS) + group.setdefault((w[0] if w[0] in "23" else "") + "=" + w.lstrip("23=")[:4], len(group)) for w in order}
    votes = np.zeros((len(rows), len(PATTERNS) + len(group)))
    for i, r in enumerate(rows):
        for f in r:
            votes[i, voter.get(f, f - 1)] = 1
    _, posterior = label_model(votes, y)
    w = fit_linear(rows, posterior, n_features)
    given = np.flatnonzero(y >= 0)
    raw = np.array([w[0] + sum(w[f] for f in rows[i]) for i in given])
    slope, offset = calibrate(raw, y[given], cut, balanced=False)
    return Model(index, tuple(w.tolist()), slope, offset)


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """keep columns and the score (0 to 1) of every row's whole text; null texts count as empty. keep must not name `out` (ValueError)."""
    reject(df.select(*keep), out)
    held = df.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in held.drop("__text").dtypes] + [f"{out} double"])

    def run(batches):
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in text_slices(batch, "__text"):
                got = model.score(part.column("__text").to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(got, pa.float64())], names=[*keep, out])

    return map_batches(held, run, schema)


def clean(df: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """The rows whose whole text scores under cut, with all columns; null texts count as empty, repeated rows are judged alike."""

    def run(batches):
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in text_slices(batch):
                yield part.filter(pa.array(model.score(part.column("text").to_pylist(), memo) < cut))

    return map_batches(df, run, df.schema)
