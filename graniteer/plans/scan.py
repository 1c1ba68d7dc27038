"""A scan: options and content to file records, one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import content as C
from ..functions import detect, fuzzy, onepass
from ..functions.metadata import metadata
from ..functions.modules import FileModule, extended
from ..functions.paths import included
from ..operators.records import has_signal


FIRST_ONLY = "sensitive_match_mode first keeps one match of each type"


def scan(df: DataFrame, cfg: ScanConfig, modules: tuple[FileModule, ...] = ()) -> DataFrame:
    """df: (path, name, size, content binary, mtime nullable). Returns one record per row that is emitted, with the modules' columns, too."""
    held = df.where(included(F.col("path"), F.col("name"), cfg.include_patterns, cfg.exclude_patterns))
    if cfg.delta_scan and cfg.last_scan_time:
        held = held.where(F.col("mtime").isNull() | (F.col("mtime") >= F.to_timestamp(F.lit(cfg.last_scan_time))))
    small = (F.lit(cfg.max_file_size) <= 0) | (F.col("size") <= cfg.max_file_size)
    most = C.content_limit(cfg.content_scan_max_bytes)
    body = F.col("content") if most is None else F.substring("content", 1, most)
    cut = F.lit(False) if most is None else F.col("size") > most
    names = detect.selected(cfg.include_sensitive_data_types, cfg.exclude_sensitive_data_types, cfg.custom_patterns) if cfg.scan_sensitive else []
    per_type, total = cfg.per_type_limit, cfg.sensitive_max_total_matches
    first = cfg.sensitive_match_mode == "first"
    searched = cfg.scan_sensitive or bool(cfg.search_terms)
    out = extended(held.withColumn("mime_type", C.mime(F.col("content"))), cfg, modules)
    out = out.withColumn("__wanted", C.eligible(F.col("name"), F.col("mime_type"), F.col("content")) if searched else F.lit(False))
    text = F.when(F.col("__wanted"), F.make_valid_utf8(body.cast("string")))

    def results(t: Column, given: dict[str, Column] | None = None) -> Column:
        found = detect.sensitive(t, names, per_type, total, cfg.redact_sensitive, cfg.custom_patterns, cfg.longtail, cfg.sensitive_window_bytes, given)
        return F.struct(C.search_hits(t, cfg.search_terms).alias("hits"), found.alias("s"))

    if cfg.sensitive_overlap == "exact" and names:
        out = out.withColumn("__text", text)
        out = out.withColumn("__r", results(F.col("__text"), onepass.critical(F.col("__text"), names, per_type, total))).drop("__text")
    else:
        out = out.withColumn("__r", C.let(text, lambda t: results(t)))  # the text is decoded once, whatever looks at it
    if cfg.fuzzy_hash:
        out = out.withColumn("fuzzy_hashes", fuzzy.fuzzy_hashes(F.col("content"), F.col("size"), cfg.fuzzy_min_size, cfg.fuzzy_max_size, cfg.fuzzy_table, cfg.fuzzy_algorithms))
    if cfg.collect_metadata:
        out = out.withColumn("metadata", metadata(F.col("content"), F.col("mime_type"), cfg.metadata_max_bytes))
    out = out.withColumns(
        {
            "hashes": F.when(small, C.hashes(F.col("content"), cfg.hash_algorithms)),
            "search_hits": F.col("__r.hits"),
            "content_scan_bytes": F.when(F.col("__wanted"), F.octet_length(body).cast("long")),
            "content_scan_truncated": F.col("__wanted") & cut,
            "sensitive_data": F.col("__r.s.data"),
            "sensitive_data_match_counts": F.col("__r.s.counts"),
            "sensitive_data_truncated": F.col("__r.s.truncated") | F.lit(True) if first else F.col("__r.s.truncated"),
        }
    )
    warnings = F.array(
        F.when(F.lit(first) & F.col("sensitive_data").isNotNull(), F.lit(FIRST_ONLY)),
        C.size_warning(F.col("size"), cfg.max_file_size),
        F.when(F.col("content_scan_truncated"), F.lit(f"content scan truncated at {most} bytes")),
        F.when(F.col("sensitive_data_truncated"), F.lit("sensitive data results truncated by configured limits")),
    )
    out = out.withColumn("collection_warnings", F.array_distinct(F.array_compact(warnings))).drop("__r", "__wanted", "content")
    return out if cfg.scan_files else out.where(has_signal(out))
