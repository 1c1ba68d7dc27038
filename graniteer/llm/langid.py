"""Language identification, words first.

A known word counts by its log frequency in each language; an unseen word falls back to
its longest known character n-gram (of the padded word), shorter ones at a discount, down to single
characters. A text's language has the largest sum over all its words.

Learning: up to about `per_lang` documents of each language (by hash, a bound on what is
fitted), all of whose words and n-grams are counted and kept. `words` and `n_grams` keep only the most frequent of each
language, where the model has to be smaller; 0, the default, keeps all.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import map_batches, reject, staged, text_slices

PER_LANG, WORDS, GRAMS = 2_000, 0, 0
MAX_GRAM, DISCOUNT = 5, 0.9
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Rows of words that a worker remembers.
MEMO = 200_000


def words_of(text: str | None) -> list[str]:
    """Lower-case words that hold a letter; numerals such as fractions and Roman numbers are none."""
    found = WORD.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def grams(word: str):
    """(n, n-gram) of a padded word, all lengths up to MAX_GRAM."""
    w = f"^{word}$"
    for n in range(1, MAX_GRAM + 1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    words: dict[str, int]
    grams: dict[str, int]
    word_rows: np.ndarray  # log frequencies: (word, lang)
    gram_rows: np.ndarray

    def row(self, word: str) -> np.ndarray:
        """One word's score in each language."""
        at = self.words.get(word)
        if at is not None:
            return self.word_rows[at]
        w = f"^{word}$"
        for n in range(min(MAX_GRAM, len(w)), 0, -1):
            hits = [self.grams[g] for i in range(len(w) - n + 1) if (g := w[i : i + n]) in self.grams]
            if hits:
                return self.gram_rows[hits].mean(0) * DISCOUNT ** (MAX_GRAM - n)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str | None], memo: Memo) -> list[tuple[str, float]]:
        """(language, score) of each whole text; memo: rows of words seen, kept within bounds."""
        out = []
        for t in texts:
            found = words_of(t)
            if not found or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            mean = memo.rows(self, found).mean(0)
            best = int(mean.argmax())
            e = np.exp((mean - mean[best]) * min(len(found), 20.0))
            out.append((self.langs[best], float(1 / e.sum())))
        return out


class Memo:
    """Rows of the words that a worker has met, MEMO of them at most."""

    def __init__(self, langs: int) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, langs))

    def rows(self, model: Model, found: list[str]) -> np.ndarray:
        ids = list(map(self.at.get, found))
        if None in ids:
            if len(self.at) > MEMO:
                self.at.clear()
            for w in found:
                if w not in self.at:
                    if len(self.at) >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[len(self.at)] = model.row(w)
                    self.at[w] = len(self.at)
            ids = list(map(self.at.get, found))
        return self.table[ids]


def fit(docs: DataFrame, usable: Column, lang: str = "lang", per_lang: int = PER_LANG, words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """Learn from the rows that `usable` admits and whose language is not null.

    Null texts teach nothing; rows that repeat an id are all in the sample or all out of it.
    """
    held = docs.where(usable & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.lit(3)).alias("h"))
    sizes = staged(held.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    few = held.join(sizes, "lang").where((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) * F.col("size") < per_lang).select("lang", "text")

    def count(batches):
        total: dict[str, Counter[str]] = {}
        for batch in batches:
            for part_ in text_slices(batch):
                for k, t in zip(part_.column("lang").to_pylist(), part_.column("text").to_pylist(), strict=True):
                    total.setdefault(k, Counter()).update(words_of(t))
                if sum(map(len, total.values())) > 200_000:
                    yield from flush(total)
        yield from flush(total)

    def flush(total):
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
        total.clear()

    def spell(batches):
        for batch in batches:
            c: Counter[tuple[str, str]] = Counter()
            for k, w, n in zip(*(batch.column(x).to_pylist() for x in ("lang", "word", "n")), strict=True):
                for g in grams(w):
                    c[k, g] += n
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in c], pa.string()), pa.array([g for _, g in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    summed = lambda x, name: staged(x.groupBy("lang", "word").agg(F.sum("n").alias("n")), name)
    counted = summed(map_batches(few, count, "lang string, word string, n bigint"), "words")
    spelled = summed(map_batches(counted, spell, "lang string, word string, n bigint"), "n-grams")
    langs = tuple(sorted(r["lang"] for r in sizes.select("lang").collect()))  # one name for each language
    if not langs:
        return Model((), {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    (known, word_rows), (units, gram_rows) = _table(counted, langs, words), _table(spelled, langs, n_grams)
    return Model(langs, known, units, word_rows, gram_rows)


def _table(counts: DataFrame, langs: tuple[str, ...], most: int) -> tuple[dict[str, int], np.ndarray]:
    """The units (of `most` > 0: the most frequent of each language), and their log frequencies in all languages."""
    total = np.zeros(len(langs))
    for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect():
        total[langs.index(r["lang"])] = r["t"]
    if most:
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("word").distinct()
        counts = counts.join(kept, "word", "left_semi")
    got = counts.select("word", "lang", "n").toArrow()
    names = sorted(set(got.column("word").to_pylist()))
    index = {w: i for i, w in enumerate(names)}
    n = np.zeros((len(names), len(langs)))
    at = {k: i for i, k in enumerate(langs)}
    n[[index[w] for w in got.column("word").to_pylist()], [at[k] for k in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return index, np.log((n + 0.5) / (total + 0.5 * (len(names) + 1)))


def identify(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred and score of every row; null texts and those without a letter are `und` with score 0.

    Equal sums go to the language first in order of name. keep must not name a column that is added (ValueError).
    """
    reject(df.select(*keep), "lang_pred", "score")
    held = df.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in held.drop("__text").dtypes] + ["lang_pred string", "score double"])

    def run(batches):
        memo = Memo(len(model.langs))
        for batch in batches:
            for part in text_slices(batch, "__text"):
                got = model.predict(part.column("__text").to_pylist(), memo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                    names=[*keep, "lang_pred", "score"],
                )

    return map_batches(held, run, schema)
