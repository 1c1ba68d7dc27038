"""Records in envelopes, run metrics, projections for export, and sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import private_file

SCHEMA_VERSION = "2"
ORDER = ("system_info", "process", "file", "metrics")
#: Fields that leave a record unless a policy admits them: fixed values.
SENSITIVE_FIELDS = ("sensitive_data", "sensitive_data_match_counts", "sensitive_data_truncated", "search_hits", "metadata", "xattrs", "acl", "alternate_data_streams")
SYSTEM_LISTS = ("installed_patches", "startup_programs", "installed_apps", "network_interfaces", "open_connections", "running_services", "users", "groups", "admins", "scheduled_tasks", "running_processes")


def without_empties(df: DataFrame) -> list[Column]:
    """Columns with empty maps, arrays and strings made null, so that JSON leaves them out."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("map<", "array<")):
            c = F.when(F.size(c) > 0, c)
        elif kind == "string":
            c = F.when(c != "", c)
        out.append(c.alias(name))
    return out


def envelopes(df: DataFrame, record_type: str) -> DataFrame:
    """(ord, record_type, json): one NDJSON line for each row."""
    payload = F.struct(*without_empties(df))
    line = F.to_json(F.struct(F.lit(record_type).alias("record_type"), F.lit(SCHEMA_VERSION).alias("schema_version"), payload.alias("payload")))
    return df.select(F.lit(ORDER.index(record_type)).alias("ord"), F.lit(record_type).alias("record_type"), line.alias("json"))


def union_records(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def has_signal(df: DataFrame) -> Column:
    """Whether a row says more than what the file is: matches, hits, fuzzy hashes, xattrs, warnings, truncation."""
    found = F.lit(False)
    kinds = dict(df.dtypes)
    for c in ("sensitive_data", "search_hits", "fuzzy_hashes", "xattrs", "alternate_data_streams", "collection_warnings"):
        if c in kinds:
            found = found | F.coalesce(F.size(c) > 0, F.lit(False))
    for c in ("content_scan_truncated", "sensitive_data_truncated"):
        if c in kinds:
            found = found | F.coalesce(F.col(c), F.lit(False))
    return found | F.coalesce(F.col("acl") != "", F.lit(False)) if "acl" in kinds else found


def metrics(df: DataFrame, emitted: Column, processes: int = 0, start: str = "", end: str = "") -> DataFrame:
    return df.agg(
        F.lit(start).alias("start_time"), F.lit(end).alias("end_time"), F.count(F.lit(1)).cast("int").alias("total_files"), F.count(F.lit(1)).cast("int").alias("files_scanned"),
        F.count_if(emitted).cast("int").alias("files_processed"), F.lit(processes).alias("total_processes"),
    )


def for_export(df: DataFrame, record_type: str, paths: bool = False, sensitive: bool = False, cmdline: bool = False) -> DataFrame:
    """The columns that may leave: without a policy, no paths, no matches, no command lines, lists only as counts."""
    if record_type == "file":
        return df.drop(*(() if paths else ("path",)), *(() if sensitive else SENSITIVE_FIELDS))
    if record_type == "process":
        return df.drop(*(() if cmdline else ("cmdline",)), *(() if paths else ("exe",)))
    if record_type == "system_info" and not sensitive:
        counts = [F.size(c).alias(f"{c}_count") for c in SYSTEM_LISTS if c in df.columns]
        return df.select(*[c for c in ("os_version", "collection_warnings") if c in df.columns], *counts)
    return df


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def write_ndjson(lines: DataFrame, path: str) -> None:
    """Distributed sink; order holds inside a partition only."""
    lines.sortWithinPartitions("ord").select("json").write.text(path)


def export_ndjson(lines: DataFrame, path: str, most: int = 104_857_600) -> list[str]:
    """One ordered file, metrics last; a file is closed after the record that takes it to `most` bytes. Streams rows to the driver."""
    stem, ext = os.path.splitext(path)
    ext, done, n, size, out = ext or ".ndjson", [], 0, 0, None
    for r in lines.orderBy("ord").toLocalIterator():
        if out is None:
            done.append(f"{stem}{ext}" if n == 0 else f"{stem}.{n}{ext}")
            out = private_file(done[-1])
            size = 0
        size += out.write(r["json"].encode() + b"\n")
        if size >= most:
            out.close()
            out, n = None, n + 1
    if out:
        out.close()
    return done


def rotation_bucket(order: list[str], most: int) -> Column:
    """File number of each line when files close after reaching `most` bytes in sum; for partitions of bounded size."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.floor(F.coalesce(F.sum(F.octet_length("json") + 1).over(before), F.lit(0)) / most)
