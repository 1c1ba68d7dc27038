"""Points of extension: own columns for file records, and matches as a table function."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..config import ScanConfig
from .detect import CRITICAL
from .onepass import scan_bytes


class FileModule(Protocol):
    """Columns of one's own: asked for once for each scan; `columns` sees path, name, size, content, mtime and mime_type."""

    name: str

    def enabled(self, cfg: ScanConfig) -> bool: ...

    def columns(self, df: DataFrame, cfg: ScanConfig) -> dict[str, Column]: ...


def extended(df: DataFrame, cfg: ScanConfig, modules: tuple[FileModule, ...]) -> DataFrame:
    """df with the columns of the modules that are enabled, in order; a name that is taken is refused (ValueError)."""
    for m in modules:
        if m.enabled(cfg):
            more = m.columns(df, cfg)
            taken = sorted(set(more) & set(df.columns))
            if taken:
                raise ValueError(f"{m.name}: columns exist already: {', '.join(taken)}")
            df = df.withColumns(more)
    return df


@udtf(returnType="pattern string, value string, start int, stop int")
class ScanMatches:
    """Matches of the critical types (comma-separated names; empty: all) in one pass, a row each, with places in bytes; at most `most` (0: all)."""

    def eval(self, text: str, names: str = "", most: int = 0):
        wanted = tuple(n for n in CRITICAL if not names or n in names.split(","))
        for row in scan_bytes(text.encode("utf-8", "replace"), wanted, 0, most) if text else ():
            yield row


def register(spark: SparkSession) -> None:
    """Make scan_matches known to SQL."""
    spark.udtf.register("scan_matches", ScanMatches)
