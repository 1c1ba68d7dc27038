"""A whole run: what a configuration asks for, from roots to records on disk."""

from __future__ import annotations

import os
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig, parse_time
from ..functions.paths import included, own_artefact, within
from ..operators import records, sysinfo
from ..operators.export import post_logs, log_records
from ..sources.files import STAT, base_columns, private_file, tree
from .scan import scan

#: Bytes of content that a worker hands over at a time.
BATCH_BYTES = 32 << 20
RAW = ("mtime", "atime", "ctime", "mode", "uid", "gid", "dev", "inode")


def roots(cfg: ScanConfig) -> tuple[str, ...]:
    return tuple(os.path.abspath(p) for p in cfg.start_paths)


def last_scan(cfg: ScanConfig) -> str:
    """The instant since which files count as changed: the option, else what the marker file says, else none."""
    if not cfg.delta_scan:
        return ""
    if cfg.last_scan_time:
        return cfg.last_scan_time
    try:
        with open(cfg.last_scan_file, encoding="utf-8") as f:
            text = f.read(64).strip()
    except OSError:
        return ""
    return text if parse_time(text) else ""


def listing(spark: SparkSession, cfg: ScanConfig, since: str = "") -> DataFrame:
    """Stat rows of the files to be scanned; no content is read. Roots that overlap count their files twice."""
    held = tree(spark, roots(cfg), xattr_bytes=cfg.xattr_max_value_size if cfg.collect_xattrs else None, acl=cfg.collect_acl)
    absolute = lambda p: os.path.abspath(p) if p else ""
    own = own_artefact(F.col("path"), absolute(cfg.output_file_name), absolute(cfg.last_scan_file), absolute(cfg.delta_cache_dir))
    held = held.where(within(F.col("path"), roots(cfg)) & ~own & included(F.col("path"), F.col("name"), cfg.include_patterns, cfg.exclude_patterns))
    if since:
        held = held.where(F.col("mtime").isNull() | (F.col("mtime") >= F.to_timestamp(F.lit(since))))
    return held.withColumn("alternate_data_streams", F.lit(None).cast("array<string>")) if cfg.scan_ads else held


def with_content(files: DataFrame) -> DataFrame:
    """files with their content, null where it cannot be read; only the rows that are left are opened."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in files.dtypes], "content binary"])

    def run(batches):
        for batch in batches:
            held, size, start = [], 0, 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with open(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
                        held.append(f.read())
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, "content"])
                    held, size, start = [], 0, i + 1

    return files.mapInArrow(run, schema)


def file_records(spark: SparkSession, cfg: ScanConfig, since: str = "") -> DataFrame:
    """One record a file, as the options ask."""
    held = scan(with_content(listing(spark, cfg, since)), cfg)
    return base_columns(held).drop(*RAW)


def plan(spark: SparkSession, cfg: ScanConfig) -> dict[str, DataFrame]:
    """Frames of the run by record type, lazy: system_info, process and file, those that are asked for."""
    out = {}
    if cfg.collect_system_info:
        out["system_info"] = sysinfo.system_info(spark, cfg.collect_scheduled_tasks, cfg.collect_users, cfg.collect_groups, cfg.collect_admins)
    if cfg.scan_processes:
        out["process"] = sysinfo.processes(spark, cfg.extended_process_info)
    if cfg.scan_files or cfg.scan_sensitive:
        out["file"] = file_records(spark, cfg, last_scan(cfg))
    return out


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def run(spark: SparkSession, cfg: ScanConfig, folder: str = "") -> list[str]:
    """Do the run: system information, processes, files, then metrics, written in this order, and posted where an endpoint is set.

    Without `folder`, to cfg.output_file_name and its rotations, in order, by way of the driver; with it, to a folder that all
    executors share, a file for each partition. The marker is written when all else is. Returns the files or the folder.
    """
    began = now()
    frames = {k: v.cache() for k, v in plan(spark, cfg).items()}
    try:
        files = frames.get("file", spark.createDataFrame([], STAT))
        emitted = files.count()
        listed = listing(spark, cfg, last_scan(cfg)).count() if "file" in frames else 0
        totals = spark.createDataFrame(
            [(began, now(), listed, listed, emitted, frames["process"].count() if "process" in frames else 0)], "start_time string, end_time string, total_files int, files_scanned int, files_processed int, total_processes int"
        )
        frames["metrics"] = totals
        lines = reduce(DataFrame.unionByName, [records.envelopes(v, k) for k, v in frames.items()])
        if folder:
            records.write_ndjson(lines, folder)
            done = [folder]
        else:
            done = records.export_ndjson(lines, cfg.output_file_name, cfg.max_output_file_size)
        if cfg.otel_endpoint:
            for k, v in frames.items():
                post_logs(log_records(v, k, cfg.export_paths, cfg.export_sensitive, cfg.export_cmdline), cfg.otel_endpoint, cfg.otel_service_name, cfg.otel_headers, timeout=cfg.otel_timeout or 5.0)
        if cfg.last_scan_file and "file" in frames:
            with private_file(cfg.last_scan_file) as f:
                f.write(now().encode())
        return done
    finally:
        for v in frames.values():
            v.unpersist()
