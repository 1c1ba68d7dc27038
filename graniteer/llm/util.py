"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches are cut to about so many bytes of text before numpy works on them.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where none is set, one of our own, deleted at exit, if all runs on this machine (master local); an error on a cluster.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="graniteer-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(own)
        found = context.getCheckpointDir()
    return found


#: Rows sent to Python at a time; texts are long, and each worker holds a batch or two.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at BATCH_ROWS rows or fewer (read when a plan runs)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_groups(df: DataFrame, by: list[str], fn, schema) -> DataFrame:
    """groupBy().applyInArrow() with small batches."""
    small_batches(df.sparkSession)
    return df.groupBy(*by).applyInArrow(fn, schema)


#: Spark's setting that deletes a query's shuffle files when the query ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    release: the files of the shuffles that made it go once it is written, and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release and before is None:
            spark.conf.unset(RELEASE)
        elif release:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def null_key(c: Column) -> Column:
    """A string key in which null is a value of its own, so that equi-joins keep it."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a record batch into slices of about `limit` bytes of `column`, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def crc_of_id(c: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(c.cast("string").cast("binary"))


def reject(df: DataFrame, *added: str) -> None:
    """ValueError if df has a column that an operator adds, or one for its own use (__*)."""
    low = {c.lower() for c in added}
    clash = [c for c in df.columns if c.lower() in low or c.startswith("__")]
    if clash:
        raise ValueError(f"columns of these names must not be in the input: {', '.join(clash)}")


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 (binary) of a row: each value's length and text in turn, n for null. Rows with one key are alike."""

    def text(c: str, kind: str) -> Column:
        col = F.col(f"`{c}`")
        plain = F.hex(col) if kind == "binary" else F.to_json(F.struct(col)) if kind.startswith(("array", "map", "struct")) else col.cast("string")
        return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.length(plain).cast("string"), F.lit(":"), plain))

    return F.unhex(F.sha2(F.concat(F.lit(""), *[text(c, k) for c, k in df.dtypes if columns is None or c in columns]), 256))


#: Rows that a ranking cell should hold, and cells that are summed up together.
CELL_ROWS, COARSE = 1_000, 1_024


def ranked(rows: DataFrame, keys: list[str], order: str = "__key", n: str = "__n", out: str = "__start", attach: DataFrame | None = None) -> DataFrame:
    """Add `out`: how many (the sum of n) of a key's rows come before, in order of the binary column `order`.

    The leading bits of `order`, which must be a hash that differs from row to row, pick a cell; rows are summed
    inside (key, cell), and the cells' offsets come from tables of sums in two levels, so that a key with a third of
    all rows is spread over all cells, whose number follows the rows. `keys` must not be null. `attach`, one row for each key, is joined by way of the
    cells' offsets, so no key's rows meet in one task for it either.
    """
    spark = rows.sparkSession
    cells = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / CELL_ROWS))
    cell = F.floor(F.conv(F.hex(F.substring(order, 1, 6)), 16, 10).cast("double") / F.lit(float(1 << 48)) * cells).cast("long")
    held = rows.withColumn("__cell", cell)
    counts = staged(held.groupBy(*keys, "__cell").agg(F.sum(n).alias("__c")), "cells").withColumn("__coarse", F.expr(f"__cell div {COARSE}"))
    before = lambda c, *by: F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = counts.groupBy(*keys, "__coarse").agg(F.sum("__c").alias("__c")).select(*keys, "__coarse", before("__coarse", *keys).alias("__b"))
    offsets = counts.withColumn("__a", before("__cell", *keys, "__coarse")).join(coarse, [*keys, "__coarse"]).select(*keys, "__cell", (F.col("__a") + F.col("__b")).alias("__before"))
    offsets = offsets if attach is None else offsets.join(attach, keys)
    inside = Window.partitionBy(*keys, "__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = held.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return numbered.join(offsets, [*keys, "__cell"]).withColumn(out, (F.col("__before") + F.col("__in")).cast("long")).drop("__cell", "__in", "__before")


#: Copies of one row are dealt out in runs of this many, so that no array grows with them.
COPY_RUN = 4_096


def each_copy(rows: DataFrame, start: str = "__start", n: str = "__n", out: str = "__rank") -> DataFrame:
    """A row for each of n copies, numbered from `start`; both columns go."""
    runs = rows.withColumn("__run", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {COPY_RUN})")))
    low = F.expr(f"{start} + __run * {COPY_RUN}")
    return runs.withColumn(out, F.explode(F.sequence(low, F.least(low + COPY_RUN, F.col(start) + F.col(n)) - 1))).drop("__run", start, n)
