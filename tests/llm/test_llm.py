"""Operators against brute force, round trips and held-out accuracy; nulls, empties, repeats and empty tables."""

import hashlib
import os
import random
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graniteer.llm import ann, crf, langid, minhash, mixing, pieces, quality_rules, sharding, suffixes, toxicity
from graniteer.llm import queries as Q
from graniteer.llm import util
from graniteer.llm.components import components
from graniteer.llm.util import crc_of_id, staged

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
have_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
have_pieces = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no piece file")


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOC)


ODD = [None, "", "   \n ", "word", "a b", "é" * 200, "same text here " * 30, "same text here " * 30, "\n\n", "x" * 5000]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1
def brute_counts(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    eight = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, seen, dup = Counter(eight), set(), 0
    covered = {j for i, e in enumerate(eight) if c[e] > 1 for j in range(i, i + 8)}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered)


def test_quality_counts_equal_brute_force():
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice("ab# ") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))).replace(" b ", "\n") for _ in range(200))]
    for t in texts:
        assert quality_rules.text_counts(t)[:5] == brute_counts(t)


def test_quality_rules_edges(spark):
    df = docs(spark, ODD).withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang"))).withColumn("fence_upper", F.lit(1))
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert len(got) == len(ODD) and got[0]["base_failed"] and not got[0]["kept"] and got[6]["base_failed"]
    assert quality_rules.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality_rules.judge(df, keep=("doc_id", "lang", "source", "fence_upper"))


def brute_fences(rows):
    """rows: (group, lang, values by name). Blended quartiles of bucketed values, by sorting."""

    def top(v):
        if v < 32:
            return v
        shift = v.bit_length() - 5
        return ((v >> shift) + 1 << shift) - 1

    def quartiles(vs):
        vs = sorted(map(top, vs))
        return [vs[-(-len(vs) * i // 4) - 1] for i in (1, 2, 3)], len(vs)

    out, prior = {}, quality_rules.PRIOR
    for k in rows[0][2]:
        whole = quartiles([v[k] for _, _, v in rows])[0]
        for g, lang, _ in rows:
            by_lang, n = quartiles([v[k] for _, x, v in rows if x == lang])
            mid = [(n * a + prior * b) // (n + prior) for a, b in zip(by_lang, whole)]
            own, n = quartiles([v[k] for x, y, v in rows if (x, y) == (g, lang)])
            out[g, lang, k] = [(n * a + prior * b) // (n + prior) for a, b in zip(own, mid)]
    return out


@pytest.mark.parametrize("groups", [0, 100])
def test_kept_equals_brute_force(spark, monkeypatch, groups):
    """Also where the fences' join is salted instead of broadcast."""
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", groups)
    rng = random.Random(8)
    texts = ["\n".join(words(rng, rng.randint(3, 30)) + rng.choice(["", "!", " A B #", " x x x", "$$$"]) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts += [t + " #" * rng.randint(0, 60) + "!" * rng.randint(0, 40) for t in texts[:40]] + ODD
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", None]), 0) for i, t in enumerate(texts)]
    counts = [dict(zip(quality_rules.COUNTS, quality_rules.text_counts(t), strict=True)) for t in texts]
    of = lambda c: {k: c[top] * 1000 // c[low] if c[low] else 0 for k, (top, low, _) in quality_rules.SIGNALS.items()} | {k: c[k] for k in quality_rules.SIZES}
    limits = brute_fences([(r[3], r[2], of(c)) for r, c in zip(rows, counts)])
    want = {}
    for r, c in zip(rows, counts):
        good = c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"]
        for k, (top, low, event) in quality_rules.SIGNALS.items():
            q1, _, q3 = limits[r[3], r[2], k]
            size = max(limits[r[3], r[2], low][1], 1)
            good &= c[top] <= (q3 + 3 * (q3 - q1)) * c[low] // 1000 + 3 * event * max(c[low], size) // size
        want[r[0]] = good
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert got == want and 20 < sum(want.values()) < 170


def test_sketch_buckets(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("v")).withColumn("b", quality_rules.bucket(F.col("v"))).withColumn("top", quality_rules.bucket_top(F.col("b")))
    assert df.where("top < v or top > v * 1.07 + 0.5").count() == 0


# 2
def brute_edf(shares, blocks):
    out, frame, start = {}, 0, 0
    while any(blocks[s] > shares[s] * frame for s in shares):
        k = {s: max(0, min(shares[s], blocks[s] - shares[s] * frame)) for s in sorted(shares)}
        length, done = sum(k.values()), dict.fromkeys(k, 0)
        for t in range(length):
            ready = [(-(-length * (done[s] + 1) // k[s]), s) for s in k if done[s] < k[s] and length * done[s] // k[s] <= t]
            s = min(ready)[1]
            out[s, shares[s] * frame + done[s]] = start + t
            done[s] += 1
        frame, start = frame + 1, start + length
    return out


def scheduled(spark, shares, blocks):
    df = spark.createDataFrame([(s, shares[s], n) for s, n in blocks.items()], "src string, share int, n long")
    plan = mixing.phases(df).select("src", "share", "phases", F.explode(F.expr(f"sequence(0L, {max(blocks.values())}L)")).alias("block"))
    return mixing.in_schedule(plan.join(df.select("src", "n"), "src").where("block < n")).collect()


def test_mixing_equals_brute_force_and_stays_near_its_shares(spark):
    shares, blocks = {"a": 5, "b": 2, "c": 1, "d": 3}, {"a": 23, "b": 40, "c": 3, "d": 9}
    rows = scheduled(spark, shares, blocks)
    assert {(r["src"], r["block"]): r["slot"] for r in rows} == brute_edf(shares, blocks)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows) and sorted(r["slot"] for r in rows) == list(range(sum(blocks.values())))
    first = [r["src"] for r in sorted(rows, key=lambda r: r["slot"])][:11]
    for t in range(1, 12):
        assert all(abs(first[:t].count(s) - t * shares[s] / 11) < 1 for s in shares)


def test_mixing_of_random_sources_equals_brute_force(spark):
    rng = random.Random(2)
    for _ in range(3):
        shares = {f"s{i}": rng.randint(1, 6) for i in range(rng.randint(1, 7))}
        blocks = {s: rng.randint(1, 30) for s in shares}
        assert {(r["src"], r["block"]): r["slot"] for r in scheduled(spark, shares, blocks)} == brute_edf(shares, blocks)


def test_mixing_edges(spark):
    df = docs(spark, ODD).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source"))).unionByName(docs(spark, ODD[:2]))
    rows = mixing.mix(df, {"s": 2}, block_rows=2).collect()
    assert len(rows) == len(ODD) + 2 and len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter([*enumerate(ODD), *enumerate(ODD[:2])])
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"s": 0})
    for name in ("slot", "Place", "__src"):
        with pytest.raises(ValueError):
            mixing.mix(df.withColumn(name, F.lit(1)))


def test_mixing_and_sharding_of_many_copies_of_one_row(spark):
    """Copies come in runs, so none is lost at a run's edge; null ids and alike rows do not matter."""
    n = 2 * util.COPY_RUN + 5
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source")).unionByName(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("t").alias("source")))
    got = mixing.mix(df, block_rows=10).collect()
    assert len(got) == n + 3 and len({(r["slot"], r["place"]) for r in got}) == n + 3
    held = sharding.shard_rows(df, "doc_id", 3).collect()
    assert len(held) == n + 3 and len({(r["shard"], r["slot"]) for r in held}) == n + 3


# 3
def test_forward_backward_equals_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    n = np.array([3, 1, 4])
    u, p = rng.standard_normal((8, 2)), rng.standard_normal((2, 2))
    got, pairs, z = crf.forward_backward(u, p, n)
    at, total = 0, 0.0
    for k in n:
        w = {y: np.exp(sum(u[at + i, y[i]] for i in range(k)) + sum(p[y[i - 1], y[i]] for i in range(1, k))) for y in itertools.product((0, 1), repeat=int(k))}
        total += np.log(sum(w.values()))
        for i in range(k):
            assert abs(got[at + i, 1] - sum(v for y, v in w.items() if y[i]) / sum(w.values())) < 1e-9
        at += k
    assert abs(z - total) < 1e-9 and abs(pairs.sum() - (n - 1).sum()) < 1e-9


def test_cut_of_scores_that_tell_nothing():
    of = lambda raw, y, balanced: [1 / (1 + np.exp(-(a * x + b))) >= 0.7 for a, b in [crf.calibrate(np.array(raw), np.array(y), 0.7, balanced)] for x in raw]
    assert of([0.0] * 5, [0, 0, 0, 1, 1], False) == [False] * 5 and of([0.0] * 5, [0, 1, 1, 1, 1], False) == [True] * 5
    assert of([0.0, 1.0, 2.0, 3.0], [0, 0, 1, 1], True) == [False, False, True, True]


@have_data
def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = Q.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_classifiers_without_labels_and_with_odd_texts(spark):
    df, none = docs(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, label in ((crf, "quality"), (toxicity, "toxic")):
        model = module.fit(df, none, F.lit(True), label)
        rows = module.score(df, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(df.limit(0), model).count() == 0


def test_lines_are_bounded_in_hash_order(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(words(rng, 5) + ("!" * 9 if i % 2 else "") for _ in range(rng.choice((1, 3, 12)))), i % 2) for i in range(60)]
    rows.append((60, "\n" * 100, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    order = [r[0] for r in df.where("doc_id < 60").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7))).select("doc_id").collect()]
    size, first, total = {r[0]: r[1].count("\n") + 1 for r in rows}, [], 0
    for i in order:
        total += size[i]
        if total > 60:
            break
        first.append(i)
    fit = lambda d, only=F.lit(True): crf.fit(d, df.select("doc_id", "quality"), only, lines=60)
    want = fit(df, F.col("doc_id").isin(first))
    assert fit(df.coalesce(1)) == want == fit(df.repartition(6, F.col("text")))


# 4
def brute_cut(rows, width=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            first.setdefault(raw[k : k + width], i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if first[raw[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), len(raw) - len(rest), sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(rest).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    passage, period = words(rng, 40), "ab" * 60
    texts = [words(rng, rng.randrange(1, 60), 30) for _ in range(60)]
    texts += [f"{words(rng, 5)} {passage} {words(rng, 5)}" for _ in range(8)] + [passage[:49], passage[:50], "é" * 80, "è" + "é" * 80, period, period[1:], "\x00" * 70, "\x00" * 90] + ODD
    rng.shuffle(texts)
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(df).collect()}
    assert got == brute_cut(list(enumerate(texts)))
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_suffix_dedup_across_boundaries_equals_brute_force(spark, monkeypatch):
    """A hot lead before varying bytes, a hot suffix after varying bytes, both cut over many buckets, and periodic texts."""
    monkeypatch.setattr(suffixes, "SUFFIX_BYTES", 400)
    rng = random.Random(14)
    # One tail for all; of the leads of 20 bytes in it, those with the least hash are anchors.
    tail = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts = [words(rng, 6) + " " + tail[: rng.randint(20, 90)] + words(rng, rng.randint(0, 9), 12) for _ in range(120)]
    texts += [rng.choice("xyz") * rng.randint(0, 3) + tail[rng.randint(0, 30) :] + rng.choice("xyz") for _ in range(80)]
    texts += ["abc" * 70, "abc" * 90, "q" * 200, "w" + "q" * 120, ("abcdefghij" * 5 + "!") * 6, "abcdefghij" * 11]
    rng.shuffle(texts)
    cuts, hot = suffixes._splitters(docs(spark, texts).select(F.col("doc_id").alias("id"), "text"), sum(map(len, texts)), 40)
    leads = Counter(c[: suffixes.LEAD] for c in cuts)
    assert max(leads.values()) > 1 and hot
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(docs(spark, texts)).collect()}
    assert got == brute_cut(list(enumerate(texts)))


def test_suffix_dedup_of_very_long_texts(spark):
    """20 MB of one period, and 20 MB on one line that another text shares a part of."""
    rng = np.random.default_rng(4)
    plain = rng.integers(97, 123, 20_000_000, np.uint8).tobytes().decode()
    period = "0123456789abcdefg" * 1_200_000
    rows = [(0, "short " + plain[7_000_000:7_000_300]), (1, plain), (2, period), (3, "x" + period[5:400] + "y"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup(df).drop("kept_text").collect()}
    assert got == {0: (306, 0, 0), 1: (20_000_000, 300, 1), 2: (20_400_000, 0, 0), 3: (397, 395, 1), 4: (0, 0, 0)}


def test_suffix_dedup_deletes_the_shuffles_of_its_steps(spark):
    """Else hashes, texts and suffixes stay on disk beside the last shuffle, until the driver happens to collect garbage."""
    rng = random.Random(21)
    passage = words(rng, 60)
    texts = [f"{words(rng, 200)} {passage} {words(rng, 200)}" for _ in range(200)]
    df = docs(spark, texts).select(F.col("doc_id").alias("id"), "text").repartition(3).cache()
    df.count()
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {p: p.stat().st_size for f in folders for p in Path(f).rglob("shuffle_*.data")}
    before, key = held(), spark.conf.get(util.RELEASE, None)
    spans = suffixes.repeated_ranges(df)
    for _ in range(100):  # files are deleted in the background
        left = sum(n for p, n in held().items() if p not in before)
        if left < 0.05 * sum(map(len, texts)):
            break
        time.sleep(0.2)
    df.unpersist()
    assert left < 0.05 * sum(map(len, texts)) and spark.conf.get(util.RELEASE, None) == key
    assert spans.count() == 199


def test_multikey_order_is_a_sort():
    rng = np.random.default_rng(5)
    for n, top in ((0, 3), (1, 3), (500, 3), (3000, 40), (3000, 2)):
        columns = [rng.integers(0, top, n).astype(np.uint64) for _ in range(4)]
        order, opens = suffixes.multikey_order(columns, 16)
        rows = list(zip(*(c[order].tolist() for c in columns)))
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert opens.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(n)]


def test_suffix_dedup_keeps_rows_without_id_and_repeats(spark):
    df = spark.createDataFrame([(1, "z" * 90), (1, "z" * 90), (None, "z" * 90)], "doc_id long, text string")
    assert [r["n_removed"] for r in suffixes.dedup(df).collect()] == [0, 0, 0]


# 5
def test_neighbours_have_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)) + 2 * rng.standard_normal((12, 16))[rng.integers(0, 12, 1500)]
    x[700:720] = x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1501, None), (1550, [0.0] * 16), (1600, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-9 for _, v, c in mine)
        hit += len({v for _, v, _ in mine} & set(want.tolist()))
    assert hit / (30 * 5) >= 0.9 and set(got) == set(range(0, 1500, 50)) and [v for _, v, _ in sorted(got[50])] == [700, 701, 702, 703, 704]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id in (0, 3, 1501)")).count() == 1


def test_neighbours_of_odd_lengths_and_extreme_norms(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8) * 10.0 ** (250 if i % 3 == 0 else -200 if i % 3 == 1 else 0)) for i in range(200)]
    rows += [(1000 + i, rng.standard_normal(5)) for i in range(60)] + [(5000, np.ones(3))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows] + [(7, [1e300] * 8)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {0, 50, 100, 150, 1000, 1050}
    rows.append((7, np.ones(8)))
    for q, near in got.items():
        v = dict(rows)[q]
        unit = lambda x: x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
        want = sorted(((float(unit(x) @ unit(v)), i) for i, x in rows if len(x) == len(v) and i != q), key=lambda z: (-z[0], z[1]))[:5]
        assert [near[k + 1][0] for k in range(5)] == [i for _, i in want] and all(abs(near[k + 1][1] - s) < 1e-12 for k, (s, _) in enumerate(want))


def test_queries_and_candidates_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    x = np.random.default_rng(7).standard_normal((600, 4))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = ann.valid(df.withColumnRenamed("vec_id", "id"), "embedding").select("id", "v")
    whole = ann.Router(np.zeros((4, 1)), np.zeros(1), 1)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(vectors, vectors.where("id % 20 = 0"), whole).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 600, 20):
        s = unit @ unit[q]
        s[q] = -9
        assert [got[q, k] for k in range(1, 6)] == np.argsort(-s)[:5].tolist()



def test_fitting_takes_memory_of_the_sample(monkeypatch):
    """Not of the sample's square, nor of the sample by the partitions."""
    monkeypatch.setattr(ann, "CELLS", 1 << 18, raising=False)
    x = np.random.default_rng(8).standard_normal((4_000, 8))
    tracemalloc.start()
    try:
        near = ann.neighbours(x, 10)
        assert tracemalloc.get_traced_memory()[1] < 20e6 < len(x) ** 2 * 8
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        assert (np.sort(near[:50]) == np.sort(np.argsort(-s[:50])[:, :10])).mean() > 0.99
        del s
        tracemalloc.reset_peak()
        tracemalloc.clear_traces()
        net = ann.router(ann.scaled(x), 150_000)
        assert net.parts == 64 and 0 < net.probes <= 64 and tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_a_query_goes_to_a_bin_once_and_meets_what_it_probes(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 90)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    names = []
    monkeypatch.setattr(ann, "staged", lambda df, name: names.append((name, util.staged(df, name))) or names[-1][1])
    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    vectors = ann.valid(df.withColumnRenamed("vec_id", "id"), "embedding").select("id", "v")
    net = ann.Router(rng.standard_normal((6, 32)), np.zeros(32), 20)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(vectors, vectors.where("id % 20 = 0"), net).collect()}
    unit, z = x / np.linalg.norm(x, axis=1, keepdims=True), net.logits(ann.scaled(x))
    part = z.argmax(1)
    for q in range(0, 700, 20):
        s = np.where(np.isin(part, np.argsort(-z[q])[:20]), unit @ unit[q], -9)
        s[q] = -9
        want = np.argsort(-s)[:5]
        assert [got[q, k + 1][0] for k in range(5)] == want.tolist() and all(abs(got[q, k + 1][1] - s[v]) < 1e-12 for k, v in enumerate(want))
    routed = dict(names)["routed"]
    assert routed.groupBy("id", "bin").count().where("count > 1").count() == 0 and routed.count() < 35 * 20 / 1.3 and dict(routed.dtypes)["v"] == "array<float>"


# 6
@have_pieces
def test_pieces_round_trip_and_best_score(spark):
    codec, rng = pieces.Codec.load(), random.Random(6)
    usable = {p: codec.scores[i] for i, p in enumerate(codec.texts) if p}

    def best(s):
        top = [0.0] + [-1e18] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 16), j):
                if s[i:j] in usable:
                    top[j] = max(top[j], top[i] + usable[s[i:j]])
            if s[j - 1] not in usable:
                top[j] = max(top[j], top[j - 1] + codec.byte_score * len(s[j - 1].encode()))
        return top[-1]

    for _ in range(300):
        t = "".join(rng.choice("the andéñ日\t\n😀 ") for _ in range(rng.randint(1, 30)))
        ids = codec.encode(t, {})
        assert codec.decode(ids) == t
        assert abs(sum(codec.scores[i] if i not in codec.byte_of else codec.byte_score for i in ids) - best("▁" + t.replace(" ", "▁"))) < 1
    df = docs(spark, ODD).withColumn("n_tokens_", F.lit(1))
    rows = {r["doc_id"]: r for r in pieces.encode_rows(df, codec).collect()}
    assert all(r["round_trip"] for r in rows.values()) and rows[0]["token_ids"] is None and rows[1]["token_ids"] == []
    back = pieces.decode_rows(pieces.encode_rows(df, codec), codec)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(ODD))


# 7
def brute_components(texts, width, percent=80):
    sets = [minhash.shingle_set(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            n = len(x & sets[j])
            if n and 100 * n >= percent * (len(x) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(7)
    texts = [words(rng, 80) for _ in range(40)]
    for base in texts[:10]:
        for _ in range(6):
            w = base.split()
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [*ODD, texts[0].upper(), "one", "ONE"]
    df = docs(spark, texts)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width).collect()}
    assert got == brute_components(texts, width)
    assert minhash.near_duplicates(df.limit(0), width).count() == 0


def test_strays_are_dealt_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ARENA_SHINGLES", 500)
    rng = random.Random(9)
    base = words(rng, 60).split()
    texts = []
    for i in range(150):
        w = [f"t{i}n{k}" if k in (at := set(rng.sample(range(60), 5))) else x for k, x in enumerate(base)] if i % 3 else list(base)
        w[59] = f"e{i}"
        texts.append(" ".join(w))
    sets = [minhash.shingle_set(t, 2) for t in texts]
    mixed = spark.createDataFrame([(1, i, 0 if i % 3 == 0 else i) for i in range(len(texts))], "key long, id long, c long")
    sig = [bytes(r["sig"]) for r in minhash.profiles(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).orderBy("id").collect()]
    sizes = spark.createDataFrame([(i, len(x), g) for i, (x, g) in enumerate(zip(sets, sig))], "id long, n long, sig binary")
    held = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    largest = Counter()
    for r in minhash.dealt(mixed, sizes, held).collect():
        largest[r["block"], r["ask_block"], r["asks"]] += len(sets[r["id"]])
    assert max(largest.values()) <= 3 * 500
    got = {(r["a"], r["b"]) for r in minhash.arena_links(mixed, sizes, held, 2, 80).collect()}
    comp = [0 if i % 3 == 0 else i for i in range(len(texts))]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    of = lambda links: {(i, comp[j]) for i, j in links} | {(j, comp[i]) for i, j in links}
    assert got <= want and want and len(got) < len(want)
    asked = lambda links: {(i, c) for i, c in of(links) if comp[i] != 0}
    assert asked(got) == asked(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# 8
def brute_shards(keys, shards, vnodes=64):
    """Every row walks clockwise by itself: own arcs first in ring order, then the overflow in turn."""
    points = sharding.ring(shards, vnodes)
    owner = [s for _, s in points]
    room = [len(keys) // shards + (j < len(keys) % shards) for j in range(shards)]
    arcs = [[] for _ in points]
    for k, order in sorted(keys, key=lambda x: x[1]):
        h = int(hashlib.md5(("\0null" if k is None else str(k)).encode()).hexdigest()[:13], 16)
        arcs[next((i for i, (p, _) in enumerate(points) if p >= h), 0)].append((k, order))
    out, used, over = {}, [0] * shards, []
    for a, rows in enumerate(arcs):
        for x in rows:
            if used[owner[a]] < room[owner[a]]:
                out[x] = (owner[a], used[owner[a]])
                used[owner[a]] += 1
            else:
                over.append((a, x))
    queue = []
    for e in range(2 * len(points)):
        j = owner[e % len(points)]
        while queue and used[j] < room[j]:
            out[queue.pop(0)] = (j, used[j])
            used[j] += 1
        if e < len(points):
            queue += [x for a, x in over if a == e]
    return out


def test_shards_equal_a_walk_row_by_row(spark):
    df = spark.range(700).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    df = df.unionByName(spark.range(90).select(F.lit(3).cast("long").alias("k"), (F.col("id") + 1000).alias("v")))
    keys = {r["v"]: (r["k"], bytes(r["key"])) for r in df.select("k", "v", util.row_key(df).alias("key")).collect()}
    want = brute_shards(list(keys.values()), 5, 8)
    got = {r["v"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(df, "k", 5, 8).collect()}
    assert got == {v: want[x] for v, x in keys.items()}


def test_shards_are_balanced_gapless_and_move_little(spark):
    df = spark.range(2003).select(F.col("id").alias("k"), F.lit(1).alias("extra"))
    at = lambda n: {r["k"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(df, "k", n).collect()}
    eight, nine = at(8), at(9)
    assert max(Counter(s for s, _ in eight.values()).values()) == 251 and min(Counter(s for s, _ in eight.values()).values()) == 250
    for s in range(8):
        assert sorted(p for x, p in eight.values() if x == s) == list(range(sum(x == s for x, _ in eight.values())))
    assert sum(eight[k][0] != nine[k][0] for k in eight) < 0.2 * len(eight)


def test_shards_of_one_key_and_of_nothing(spark):
    df = spark.createDataFrame([(None, i) for i in range(10)] + [(1, 1), (1, 1)], "k long, v int")
    assert set(Counter(r["shard"] for r in sharding.shard_rows(df, "k", 4).collect()).values()) == {3}
    assert sharding.shard_rows(df.limit(0), "k", 4).count() == 0
    for name in ("shard", "Slot", "__key"):
        with pytest.raises(ValueError):
            sharding.shard_rows(df.withColumn(name, F.lit(1)), "k")


# 9
@have_data
def test_language_of_held_out_rows(spark):
    got = Q.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_edges(spark):
    df = docs(spark, ["the cat sat", *ODD, "123 !?"]).withColumn("lang", F.when(F.col("doc_id") > 3, F.lit("en")).when(F.col("doc_id") == 0, F.lit("xx")))
    rows = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df, F.lit(True))).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[11]["lang_pred"] == "und" and rows[0]["lang_pred"] == "xx"
    assert langid.identify(df, langid.fit(df.limit(0), F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_letters_decide_what_is_undetermined(spark):
    df = docs(spark, ["½ ²", "Ⅷ ①", "x²", "٣٤", "日本", "a", "①b"])
    model = langid.fit(docs(spark, ["a b c"] * 3), F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert got == {0: "und", 1: "und", 2: "en", 3: "und", 4: "en", 5: "en", 6: "en"}
    with pytest.raises(ValueError):
        langid.identify(df.withColumn("score", F.lit(1)), model, keep=("doc_id", "score"))


def test_word_backoff_equals_brute_force(spark):
    rng = random.Random(13)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 7)))
    known = {"xx": [word("abcd") for _ in range(40)], "yy": [word("cdef") for _ in range(40)]}
    rows = [(i, " ".join(rng.choice(known[k]) for _ in range(20)), k, "s", 0) for i, k in enumerate(["xx", "yy"] * 30)]
    model = langid.fit(spark.createDataFrame(rows, DOC).repartition(3), F.lit(True))
    count, gram = Counter(), Counter()
    for _, t, k, _, _ in rows:
        for w in t.split():
            count[k, w] += 1
            for n in range(1, 6):
                p = f"^{w}$"
                gram.update((k, p[i : i + n]) for i in range(len(p) - n + 1))

    def logs(table, unit):
        units = {u for _, u in table}
        return np.array([np.log((table[k, unit] + 0.5) / (sum(c for (x, _), c in table.items() if x == k) + 0.5 * (len(units) + 1))) for k in ("xx", "yy")])

    def score(w):
        if any((k, w) in count for k in ("xx", "yy")):
            return logs(count, w)
        p = f"^{w}$"
        for n in range(min(5, len(p)), 0, -1):
            seen = [logs(gram, p[i : i + n]) for i in range(len(p) - n + 1) if any((k, p[i : i + n]) in gram for k in ("xx", "yy"))]
            if seen:
                return np.mean(seen, 0) * 0.9 ** (5 - n)

    texts = [" ".join(rng.choice([word("abcdef"), rng.choice(known["xx"]), rng.choice(known["yy"])]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        mean = np.mean([score(w) for w in t.split()], 0)
        e = np.exp((mean - mean.max()) * min(len(t.split()), 20))
        assert got[i][0] == ("xx", "yy")[int(mean.argmax())] and abs(got[i][1] - e.max() / e.sum()) < 1e-9


# 10
@have_data
def test_toxicity_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = Q.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9


def test_label_model_finds_good_bad_and_dependent_voters():
    rng = np.random.default_rng(1)
    n = 6000
    y = rng.random(n) < 0.2
    hit = lambda a, b: np.where(y, rng.random(n) < a, rng.random(n) < b)
    one = hit(0.7, 0.02)
    votes = np.stack([one, one & (rng.random(n) < 0.95), hit(0.6, 0.05), hit(0.5, 0.05), hit(0.3, 0.3), hit(0.8, 0.1)], 1).astype(float)
    known = np.where(rng.random(n) < 0.2, y, -1)
    model, p = toxicity.label_model(votes, known)
    assert ((p > 0.5) == y).mean() > 0.93 and {int(model.parent[0]), int(model.parent[1])} & {0, 1}
    rates = np.exp(model.log_rate[2:, :, 0, 1])
    assert abs(rates[0] - [0.05, 0.6]).max() < 0.08 and abs(rates[2] - [0.3, 0.3]).max() < 0.08
    # No row's posterior looks at its own label.
    for v in {tuple(r) for r in votes[:50]}:
        assert len({round(x, 9) for x in p[(votes == v).all(1)]}) == 1


def test_label_model_posterior_equals_brute_force():
    rng = np.random.default_rng(2)
    parent, rate = np.array([-1, 0, 0, 2]), rng.uniform(0.1, 0.9, (4, 2, 2, 2))
    rate[..., 0] = 1 - rate[..., 1]
    votes = (rng.random((30, 4)) < 0.5).astype(float)
    got = toxicity.LabelModel(0.3, parent, np.log(rate)).posterior(votes)
    for v, g in zip(votes.astype(int), got):
        joint = [w * np.prod([rate[j, c, v[parent[j]] if parent[j] >= 0 else 0, v[j]] for j in range(4)]) for c, w in ((0, 0.7), (1, 0.3))]
        assert abs(g - joint[1] / sum(joint)) < 1e-9


def test_dependence_forest_is_the_best_one():
    import itertools

    rng = np.random.default_rng(3)
    n = 3000
    p = (rng.random(n) < 0.5).astype(float)
    a, b = rng.random(n) < 0.4, rng.random(n) < 0.4
    votes = np.stack([a, a ^ (rng.random(n) < 0.05), b, b ^ (rng.random(n) < 0.1), rng.random(n) < 0.5], 1).astype(float)
    parent = toxicity.forest(votes, p, 1 - p)
    assert {frozenset((i, int(j))) for i, j in enumerate(parent) if j >= 0} == {frozenset((0, 1)), frozenset((2, 3))}
    assert all(parent[i] != j or parent[j] != i for i, j in itertools.permutations(range(5), 2))


def test_toxicity_does_not_depend_on_layout_and_repeated_labels(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, 30) + (" vile" * (i % 4) if i % 5 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    one = toxicity.fit(df, marks, F.lit(True))
    again = marks.unionByName(marks.where("toxic = 0").withColumn("toxic", F.lit(None).cast("int"))).unionByName(marks).unionByName(spark.createDataFrame([(None, 1)], marks.schema))
    assert toxicity.fit(df.repartition(7), again, F.lit(True)) == one and "=vile" in one.index
    assert toxicity.clean(df, one).count() == toxicity.score(df, one).where("score < 0.7").count()
    with pytest.raises(ValueError):
        toxicity.score(df.withColumn("score", F.lit(1)), one, keep=("doc_id", "score"))


# pipeline
@have_data
@have_pieces
def test_pipeline_equals_its_parts(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    kept, held = source, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        held[name] = kept.collect()
        if name != "tokens":
            assert kept.columns == source.columns
    texts = {r["doc_id"]: r["text"] for r in held["toxicity"]}
    ids = sorted(texts)
    comp = brute_components([texts[i] for i in ids], 5)
    assert sorted(r["doc_id"] for r in held["near-duplicates"]) == [ids[k] for k, (_, c) in comp.items() if k == c]
    cut = brute_cut([(r["doc_id"], r["text"]) for r in held["near-duplicates"]])
    assert all(len(r["text"].encode()) <= cut[r["doc_id"]][0] - cut[r["doc_id"]][1] for r in held["repeated passages"])
    assert Counter(r["doc_id"] for r in held["mixing"]) == Counter(r["doc_id"] for r in held["repeated passages"])
    assert all(r["round_trip"] for r in held["tokens"]) and len(held["tokens"]) == len(held["mixing"])


def near_shares(rows, block_rows=64):
    """In order of (slot, place), no source strays a block from its share of a frame; given: rows of whole slots."""
    blocks = {s: -(-n // block_rows) for s, n in Counter(r["source"] for r in rows).items()}
    shares = {s: Q.SHARES.get(s, 1) for s in blocks}
    want = [s for (s, _), _ in sorted(brute_edf(shares, blocks).items(), key=lambda x: x[1])]
    got = {}
    for r in rows:
        got.setdefault(r["slot"], []).append(r)
    assert [{r["source"] for r in got[t]} for t in sorted(got)] == [{s} for s in want] and sorted(got) == list(range(len(want)))
    assert all(sorted(r["place"] for r in x) == list(range(len(x))) for x in got.values())
    frame = sum(shares.values())
    for start in range(0, frame * min(b // shares[s] for s, b in blocks.items()), frame):
        for t in range(1, frame + 1):
            assert all(abs(want[start : start + t].count(s) - t * shares[s] / frame) < 1 for s in shares)


@have_data
@have_pieces
def test_pipeline_keeps_the_mixture(spark):
    """The result of run() and of many files is in the mixture's order."""
    near_shares(corpus_pipeline.run(spark, SF).collect())
    rng = random.Random(11)
    rows = [(i, words(rng, rng.choice((2, 2, 2, 400))), "en", "src0" if i % 2 else f"src{i % 3 + 1}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOC).repartition(6).withColumn("n_chars", F.length("text").cast("long"))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = staged(corpus_pipeline.mix_sources(spark, df, SF), "mixing")
        out = corpus_pipeline.encode(spark, mixed, SF)
        parts = out.select(F.spark_partition_id().alias("part"), "slot", "place", "source", "doc_id").collect()
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len({r["part"] for r in parts}) > 3 and len(parts) == 3000
    assert [(r["slot"], r["place"]) for r in parts] == sorted((r["slot"], r["place"]) for r in parts)
    near_shares(parts)


def test_pipeline_folds_only_rows_of_one_id_and_text(spark):
    rng = random.Random(5)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(1, a), (1, b), (1, a), (2, c), (None, d), (None, d), (None, e), (None, c + " x"), (3, None), (3, None), (None, None), (7, b)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(5)
    out = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    first = min(a, b, key=lambda t: hashlib.sha256(t.encode()).digest())  # the text that keeps the id
    assert got == Counter([(1, a), (2, c), (None, d), (None, e), (3, None), (None, None)] + [(7, b) if first == a else (1, b)])
    # Ranges found in one text of an id are not cut from another.
    passage = words(rng, 30)
    texts = [(1, f"{passage} {a}"), (1, f"{b} {passage} y"), (2, f"z {passage}"), (None, f"q {d} {passage}")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOC)
    cut = [(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(spark, df, SF).collect()]
    one = min((t for i, t in texts if i == 1), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert (1, one) in cut and len(cut) == 4
    assert all(passage not in t for i, t in cut if t != one) and {i for i, _ in cut} == {1, 2, None}
    assert all(any(x in t for _, t in cut) for x in (a, b, d))


@have_pieces
def test_every_stage_takes_odd_rows(spark, tmp_path):
    """Nulls in all columns, empty and repeated rows, extra columns with clashing names, an empty table."""
    spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else None, len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[4], (None, None, None, None, None), (None, "z" * 80, None, None, None), (None, "z" * 80, None, None, None)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("odd") for c in ("slot", "component_id", "token_ids", "row_id", "score", "extra")})
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, str(tmp_path))
        assert name == "tokens" or got.columns == list(corpus_pipeline.COLUMNS)
        left[name] = got.collect()
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert len(left["toxicity"]) == len(left["repeated passages"]) == len(left["mixing"]) == len(left["tokens"]) == len(rows)
    assert Counter(map(tuple, left["mixing"])) == Counter(rows)
    assert Counter((r["doc_id"], r["token_ids"] is None, r["round_trip"]) for r in left["tokens"]) == Counter((i, t is None, True) for i, t, *_ in rows)
    assert Counter(r["doc_id"] for r in left["near-duplicates"]) == Counter([0, 1, 2, 3, 4, 5, 6, 8, 9, None, None])
    assert [len(r["text"]) for r in left["repeated passages"] if r["doc_id"] in (6, 7)] in ([len(ODD[6]), 0], [0, len(ODD[6])])


def test_crc_is_that_of_the_id_as_text(spark):
    import zlib

    assert [r[0] for r in spark.range(3).select(crc_of_id(F.col("id"))).collect()] == [zlib.crc32(str(i).encode()) for i in range(3)]
