"""Quality rules with thresholds that adapt to each language and source.

Signals are integers (parts in a thousand). For each (language, source) a mergeable
quantile sketch is kept of each signal and of the sizes that signals are parts of: counts in log-linear buckets
(exact below 32, then 16 buckets for each power of two, so a quantile is at most 1/16 off). Sketches merge by adding
counts, hence the result does not depend on partitions or retries.

Quartiles of a group are blended with those of its language, which are blended with the corpus's, in
proportion to the documents in each (PRIOR documents' weight for the wider one), so that small groups lean on the wider
sketch and nothing changes at a threshold of size. From the quartiles come Tukey fences, which take the place of fixed
cutoffs, and an allowance of SPREADS events in a document of the group's median size, in proportion for longer ones.
Documents are joined with their group's fences and kept if they are inside all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import map_batches, null_key, reject, staged, text_slices

WINDOW = 8
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_adjacent", "n_bangs", "n_upper")
#: Signal: numerator, denominator, size of one event in the numerator's unit (a repeat is two windows).
SIGNALS = {
    "symbols": ("n_symbols", "word_chars", 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 2 * WINDOW),
    "adjacent": ("n_adjacent", "n_words", 1),
    "bangs": ("n_bangs", "word_chars", 1),
    "upper": ("n_upper", "word_chars", 1),
}
SIZES = ("word_chars", "n_lines", "n_words")
#: A fence is the third quartile plus so many interquartile ranges and events; documents that the wider sketch counts for.
SPREADS, PRIOR = 3, 100
#: Fences are broadcast up to so many groups (some 100 bytes each); beyond, the join is salted.
BROADCAST_GROUPS, SALTS = 20_000, 32


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW consecutive words that occur twice or more."""
    n, width = len(ids), 1
    rank = ids
    while width < WINDOW:
        if len(rank) <= width:
            return 0
        pair = rank[:-width] * np.int64(len(ids) + 1) + rank[width:]
        seen, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(seen) == len(pair):
            return 0
        rank, width = rank.astype(np.int64), 2 * width
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(counts[rank] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at x20 and x09-x0D, nothing else
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = np.frombuffer(raw, np.uint8)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(ids) if len(known) < len(words) else 0, len(lines), int((ids[1:] == ids[:-1]).sum()), text.count("!"),
        int(((letters >= 65) & (letters <= 90)).sum()),
    )


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep columns and COUNTS of every row; texts are read in slices of bounded size."""
    held = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in held.drop("__text").dtypes] + [f"{c} bigint" for c in COUNTS])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "__text"):
                rows = [text_counts(t) for t in part.column("__text").to_pylist()]
                cols = [part.column(c) for c in keep] + [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *COUNTS])

    return map_batches(held, run, schema)


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number from 0 on."""
    shift = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(shift * 16 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest number in a bucket."""
    shift = F.floor((b - 16) / 16)
    return F.when(b < 32, b).otherwise((b - shift * 16 + 1) * F.pow(F.lit(2.0), shift) - 1).cast("bigint")


def signal(name: str) -> Column:
    top, below, _ = SIGNALS[name]
    return F.when(F.col(below) > 0, F.expr(f"{top} * 1000 div {below}")).otherwise(F.lit(0)).cast("bigint")


def sketches(counted: DataFrame) -> DataFrame:
    """lk, sk, signal, bucket, n: one sketch per language and source of each signal and size, null being a value."""
    values = {k: signal(k) for k in SIGNALS} | {k: F.col(k) for k in SIZES}
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), bucket(v).alias("bucket")) for k, v in values.items()])
    held = counted.select(null_key(F.col("lang")).alias("lk"), null_key(F.col("source")).alias("sk"), F.explode(rows).alias("x"))
    return held.groupBy("lk", "sk", "x.signal", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lk, sk, an upper fence for each signal and the median of each size."""

    def of(keys: list[str], name: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "signal")
        run = merged.withColumns({"below": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
        q = [F.min(F.when(F.col("below") * 4 >= F.col("all") * i, bucket_top(F.col("bucket")))).alias(f"q{i}") for i in (1, 2, 3)]
        quartiles = run.groupBy(*keys, "signal").agg(*q, F.max("all").alias("docs"))
        return quartiles.select(*keys, "signal", F.struct("q1", "q2", "q3", "docs").alias(name))

    def blend(own: str, wide: str, q: str) -> str:
        return f"({own}.docs * {own}.{q} + {PRIOR} * {wide}.{q}) div ({own}.docs + {PRIOR})"

    narrow, by_lang, whole = of(["lk", "sk"], "a"), of(["lk"], "b"), of([], "c")
    joined = narrow.join(by_lang, ["lk", "signal"]).join(whole, "signal")
    joined = joined.withColumn("m", F.expr(f"named_struct({', '.join(f"'{q}', {blend('b', 'c', q)}" for q in ('q1', 'q2', 'q3'))})"))
    joined = joined.withColumns({q: F.expr(blend("a", "m", q)) for q in ("q1", "q2", "q3")})
    limit = F.when(F.col("signal").isin(*SIZES), F.greatest(F.col("q2"), F.lit(1))).otherwise(F.expr(f"q3 + {SPREADS} * (q3 - q1)"))
    return joined.groupBy("lk", "sk").pivot("signal", [*SIGNALS, *SIZES]).agg(F.first(limit)).select("lk", "sk", *[F.col(k).alias(f"fence_{k}") for k in SIGNALS], *[F.col(k).alias(f"median_{k}") for k in SIZES])


def with_fences(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with their group's limits, without meeting at one task for a large group."""
    held = counted.withColumns({"lk": null_key(F.col("lang")), "sk": null_key(F.col("source"))})
    if limits.count() <= BROADCAST_GROUPS:
        return held.join(F.broadcast(limits), ["lk", "sk"])
    salts = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return held.withColumn("salt", F.pmod(F.xxhash64(*[c for c in counted.columns]), F.lit(SALTS)).cast("int")).join(salts, ["lk", "sk", "salt"]).drop("salt")


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep columns (lang and source among them), COUNTS, limits, base_failed, each signal's verdict and kept, for every row.

    Null texts and empty ones count nothing and fail the base rule; null languages and sources
    are groups of their own; repeated rows are judged alike; an empty table gives none. A column of keep named as one
    of those added is refused (ValueError); others of the input are left out.
    """
    added = [*COUNTS, "lk", "sk", "salt", "base_failed", "kept", *[f"{p}_{k}" for k in SIGNALS for p in ("fence", "ok")], *[f"median_{k}" for k in SIZES]]
    reject(df.select(*keep), *added)
    counted = staged(measure(df, text, keep), "quality-counts")
    held = with_fences(counted, staged(fences(sketches(counted)), "fences"))
    held = held.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    for k, (top, below, event) in SIGNALS.items():
        most = F.expr(f"fence_{k} * {below} div 1000 + {SPREADS * event} * greatest({below}, median_{below}) div median_{below}")
        held = held.withColumn(f"ok_{k}", F.col(top) <= most)
    kept = ~F.col("base_failed")
    for k in SIGNALS:
        kept = kept & F.col(f"ok_{k}")
    return held.withColumn("kept", kept).drop("lk", "sk")
