"""Content-incremental rescans: chunk results of the last scan are taken where a chunk and its neighbours have not changed.

State is a table with a row for each chunk: (path_key, fingerprint, read_limit, idx, n_chunks, mtime, chunk_hash, hits, found). A chunk's
results are those of matches that start in it: counts of search terms, and runs of equal values of each critical
type. A file's results are its chunks', summed and strung together in order, under the limits. Results are reused only under the
same fingerprint of options and read limit. A file in which what may be one match is longer than a chunk, or terms overlap themselves,
is one chunk as a whole, since neighbours do not show where a match starts there. A path is one file: rows must not repeat it.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import content as C
from ..functions import detect, onepass
from .delta import kept_by_cache, path_key, reusable

STATE = "path_key string, fingerprint string, read_limit long, idx int, n_chunks int, mtime timestamp, chunk_hash string, hits map<string,int>, found array<struct<k:string,v:array<struct<value:string,n:int>>>>"
#: Full-file work reads a file anyway: chunks pay from so many on.
LEAST_CHUNKS = 6


def patterns(cfg: ScanConfig) -> list[str]:
    return detect.selected(cfg.include_sensitive_data_types, cfg.exclude_sensitive_data_types, cfg.custom_patterns) if cfg.scan_sensitive else []


def sensitive_by_chunk(cfg: ScanConfig) -> bool:
    """Whether sensitive results can be reused by chunk: critical types only, all matches."""
    names = patterns(cfg)
    return bool(names) and all(n in detect.CRITICAL for n in names) and cfg.sensitive_match_mode == "all"


def applies(cfg: ScanConfig, size: Column, full_file_work: bool) -> Column:
    """Whether a file goes by chunks: not where values are redacted, nor small files that are read whole for hashes."""
    if cfg.delta_cache_mode != "chunk" or not (cfg.search_terms or cfg.scan_sensitive) or (cfg.scan_sensitive and cfg.redact_sensitive):
        return F.lit(False)
    limit = C.content_limit(cfg.content_scan_max_bytes)
    read = size if limit is None else F.least(size, F.lit(limit))
    return F.ceil(read / cfg.delta_chunk_bytes) >= LEAST_CHUNKS if full_file_work else F.lit(True)


def run_lengths(values: Column) -> Column:
    """Equal neighbours of an array as (value, n)."""
    start = F.array().cast("array<struct<value:string,n:int>>")
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, v: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(v.alias("value"), (last(a)["n"] + 1).alias("n"))))
    return F.aggregate(values, start, lambda a, v: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["value"] == v), grown(a, v)).otherwise(F.concat(a, F.array(F.struct(v.alias("value"), F.lit(1).alias("n"))))))


def spelled_out(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))


#: Bytes that matches without blanks are made of, and what each of them holds.
WORD = r"A-Za-z0-9._%+@\-"
MARKS = {"email": "@", "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "aws_access_key": "AKIA", "jwt_token": "eyJ"}


def undivided(text: Column, cfg: ScanConfig) -> Column:
    """Whether a file (its bytes as ISO-8859-1) may hold a match over more than a chunk and its neighbour, so that it is searched as a whole."""
    size, names = cfg.delta_chunk_bytes, patterns(cfg) if sensitive_by_chunk(cfg) else []
    runs = [rf"[0-9][0-9 \-]{{{size},}}"] if "credit_card" in names else []
    marks = "|".join(m for n, m in MARKS.items() if n in names)
    runs += [rf"(?<![{WORD}])(?=[{WORD}]{{{size + 1}}})[{WORD}]*?(?:{marks})"] if marks else []
    runs += [rf'(?i:api_key|api-secret|access-token)[ \t:="A-Za-z0-9_\-]{{{max(size - 8, 1)},}}'] if "api_key" in names else []
    out = F.lit(any(len(t.encode()) - 1 > size for t in cfg.search_terms))
    if runs:
        out = out | text.rlike("|".join(runs))
    for t in cfg.search_terms:  # "aa" in "aaa": what is counted hangs on where counting starts
        b = t.encode()
        for k in range(1, len(b)):
            if b.endswith(b[:k]):
                out = out | text.contains((b + b[k:]).decode("latin-1"))
    return out


def chunk_table(now: DataFrame, cfg: ScanConfig) -> DataFrame:
    """now: (path, content, mtime). A row for each chunk, with the chunks before and after it."""
    limit = C.content_limit(cfg.content_scan_max_bytes)
    body = F.col("content") if limit is None else F.substring("content", 1, limit)
    held = now.select(path_key(F.col("path")).alias("path_key"), "mtime", body.alias("__c")).where(F.octet_length("__c") > 0)
    held = held.withColumn("__size", F.when(undivided(F.decode("__c", "ISO-8859-1"), cfg), F.octet_length("__c")).otherwise(cfg.delta_chunk_bytes))
    held = held.withColumn("n_chunks", F.ceil(F.octet_length("__c") / F.col("__size")).cast("int"))
    each = held.select("path_key", "mtime", "n_chunks", "__c", "__size", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("idx"))
    piece = lambda i: F.when(i >= 0, F.substring("__c", i * F.col("__size") + 1, F.col("__size"))).otherwise(F.lit(b""))
    return each.select("path_key", "mtime", "n_chunks", "idx", piece(F.col("idx") - 1).alias("before"), piece(F.col("idx")).alias("chunk"), piece(F.col("idx") + 1).alias("after")).withColumn("chunk_hash", F.sha2("chunk", 256))


def chunk_hits(terms: tuple[str, ...]) -> Column:
    """Counts of terms that start in the chunk (and may end in the next)."""
    if not terms:
        return F.lit(None).cast("map<string,int>")
    text = lambda t: F.decode(F.concat("chunk", F.substring("after", 1, len(t.encode()) - 1)), "ISO-8859-1")
    each = F.array(*[F.struct(F.lit(t).alias("k"), C.search_count(text(t), t.encode().decode("latin-1")).alias("v")) for t in terms])
    return F.map_from_entries(F.filter(each, lambda x: x["v"] > 0))


def chunk_found(names: list[str], overlap: str = "independent") -> Column:
    """Critical values that start in the chunk, looked for in it and its neighbours, as runs; each type by itself, unless overlap is `exact`."""
    wanted = tuple(n for n in detect.CRITICAL if n in names)
    kind = "array<struct<k:string,v:array<struct<value:string,n:int>>>>"
    passes = [wanted] if overlap == "exact" else [(n,) for n in wanted]
    if not wanted:
        return F.lit(None).cast(kind)

    @F.pandas_udf("array<struct<k:string,v:array<string>>>")
    def run(before: pd.Series, chunk: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(before, chunk, after, strict=True):
            if b is None:
                out.append(None)
                continue
            low, high = len(a), len(a) + len(b)
            held: dict[str, list[str]] = {}
            text = bytes(a) + bytes(b) + bytes(c)
            for some in passes:
                for name, value, start, _ in onepass.scan_bytes(text, some):
                    if low <= start < high:
                        held.setdefault(name, []).append(value)
            out.append([{"k": n, "v": held[n]} for n in wanted if n in held])
        return pd.Series(out, dtype=object)

    return F.transform(run("before", "chunk", "after"), lambda p: F.struct(p["k"].alias("k"), run_lengths(p["v"]).alias("v"))).cast(kind)


def rescan(now: DataFrame, state: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The next state of the files in now, with `reused`: chunk results are those of state where they hold, else worked out.

    Only the chunks that have changed, and their neighbours, are searched again.
    """
    mark, limit = cfg.fingerprint(), C.content_limit(cfg.content_scan_max_bytes) or 0
    names = patterns(cfg) if sensitive_by_chunk(cfg) else []
    old = state.where((F.col("fingerprint") == mark) & (F.col("read_limit") == limit))
    marked = reusable(chunk_table(now, cfg), old.select("path_key", "idx", "chunk_hash"), "path_key")
    known = old.select("path_key", "idx", F.col("n_chunks").alias("__n"), F.col("hits").alias("__hits"), F.col("found").alias("__found"))
    # A last chunk's results hold only if it was the last before: a match may have gone on.
    whole = (F.col("idx") + 1 < F.col("n_chunks")) | (F.col("__n") == F.col("n_chunks"))
    joined = marked.join(known, ["path_key", "idx"], "left").withColumn("reuse", F.coalesce(F.col("reuse") & whole, F.lit(False)))
    fresh = joined.where("not reuse").withColumns({"hits": chunk_hits(cfg.search_terms), "found": chunk_found(names, cfg.sensitive_overlap)})
    kept = joined.where("reuse").withColumns({"hits": F.col("__hits"), "found": F.col("__found")})
    both = fresh.unionByName(kept)
    return both.select("path_key", F.lit(mark).alias("fingerprint"), F.lit(limit).cast("long").alias("read_limit"), "idx", "n_chunks", "mtime", "chunk_hash", "hits", "found", F.col("reuse").alias("reused"))


def file_hits(chunks: DataFrame) -> DataFrame:
    """(path_key, term, hits): a file's counts are the sum of its chunks'."""
    return chunks.select("path_key", F.explode("hits").alias("term", "n")).groupBy("path_key", "term").agg(F.sum("n").alias("hits"))


def file_sensitive(chunks: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(path_key, sensitive struct<data, counts, truncated>): values in order of chunk and type, keys once each, under the limits."""
    names = patterns(cfg)
    held = chunks.groupBy("path_key").agg(F.sort_array(F.collect_list(F.struct("idx", "found"))).alias("c"))

    def of(name: str) -> Column:
        runs = F.flatten(F.transform("c", lambda x: F.flatten(F.transform(F.filter(x["found"], lambda p: p["k"] == name), lambda p: p["v"]))))
        values = spelled_out(runs)
        return F.array_distinct(values) if name == "api_key" else values

    given = {n: of(n) for n in detect.CRITICAL if n in names}
    return held.select("path_key", detect.sensitive(F.lit(""), list(given), cfg.per_type_limit, cfg.sensitive_max_total_matches, cfg.redact_sensitive, given=given).alias("sensitive"))


def next_state(state: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """Entries of fresh replace those of state; the newest files stay while the sum of their content hashes' and values' size is within `most`."""
    both = state.join(fresh.select("path_key").distinct(), "path_key", "left_anti").unionByName(fresh.select(*state.columns))
    size = F.octet_length(F.to_json(F.struct("chunk_hash", "hits", "found")))
    files = both.groupBy("path_key").agg(F.max("mtime").alias("mtime"), F.sum(size).alias("size"))
    return both.join(kept_by_cache(files, most).where("kept").select("path_key"), "path_key", "left_semi")


def save(state: DataFrame, folder: str) -> str:
    """Write a snapshot of the state beside the earlier ones; one that is not whole has no _SUCCESS file and is never read."""
    path = f"{folder.rstrip('/')}/{datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%S%f')}"
    state.write.parquet(path)
    return path


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The latest whole snapshot, or an empty state."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in hadoop.listStatus(fs)) if hadoop.exists(fs) else []
    whole = [p for p in found if hadoop.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    return spark.read.schema(STATE).parquet(whole[-1]) if whole else spark.createDataFrame([], STATE)
