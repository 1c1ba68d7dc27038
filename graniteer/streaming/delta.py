"""Incremental rescans: by time, by chunk, and what a bounded cache keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changed_since(mtime: Column, last: Column) -> Column:
    """Kept unless strictly older; rows without a time are kept."""
    return mtime.isNull() | (mtime >= last)


def chunks(df: DataFrame, key: str, content: str, chunk_bytes: int) -> DataFrame:
    """(key, idx, chunk, chunk_hash): content in pieces of chunk_bytes, all but the last full."""
    n = F.greatest(F.ceil(F.octet_length(content) / chunk_bytes).cast("int"), F.lit(0))
    each = df.where(n > 0).select(key, F.col(content).cast("binary").alias("__c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    piece = F.substring("__c", F.col("idx") * chunk_bytes + 1, F.lit(chunk_bytes))
    return each.select(key, "idx", piece.alias("chunk"), F.sha2(piece, 256).alias("chunk_hash"))


def reusable(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """now with `same` and `reuse`: a chunk's results hold if it and both neighbours are what they were.

    A neighbour that does not exist now is not asked for.
    """
    old = before.select(key, "idx", F.col("chunk_hash").alias("__old"))
    w = Window.partitionBy(key).orderBy("idx")
    joined = now.join(old, [key, "idx"], "left").withColumn("same", F.coalesce(F.col("chunk_hash") == F.col("__old"), F.lit(False)))
    near = F.coalesce(F.lag("same").over(w), F.lit(True)) & F.coalesce(F.lead("same").over(w), F.lit(True))
    return joined.withColumn("reuse", F.col("same") & near).drop("__old")


#: Ranges of time that entries are dealt to; the times at their edges, where many may meet, are cut by the first byte of the key.
TIME_RANGES = 200


def kept_by_cache(entries: DataFrame, most: int, key: str = "path_key") -> DataFrame:
    """Newest entries first, by key downwards among equals, while their sizes' sum stays within `most`; entries: (key hex, mtime, size).

    Entries are dealt to cells in that order (a range of time, or an edge and the key's first byte), summed inside their cell, and the
    cells' offsets come from a table of at most 257 * TIME_RANGES sums or so. Entries without a time are the oldest.
    """
    marks = entries.agg(F.percentile_approx("mtime", F.array(*[F.lit(i / TIME_RANGES) for i in range(1, TIME_RANGES)]), F.lit(10_000)).alias("m")).first()["m"]
    known = F.array(*[F.lit(m) for m in sorted(set(marks))]) if marks else F.array().cast(f"array<{dict(entries.dtypes)['mtime']}>")
    under, at = F.size(F.filter(known, lambda m: m < F.col("mtime"))), F.array_contains(known, F.col("mtime"))
    age = F.when(F.col("mtime").isNull(), 2 * TIME_RANGES + 2).otherwise(2 * TIME_RANGES - 2 * under - at.cast("int"))
    byte = F.when(at | F.col("mtime").isNull(), 255 - F.conv(F.substring(key, 1, 2), 16, 10).cast("int")).otherwise(0)
    held = entries.withColumn("__cell", age * 256 + byte)
    sums = held.groupBy("__cell").agg(F.sum("size").alias("__s"))
    sums = sums.select("__cell", F.coalesce(F.sum("__s").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__cell").orderBy(F.desc("mtime"), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("__in", F.sum("size").over(w)).join(F.broadcast(sums), "__cell").withColumn("kept", F.col("__in") + F.col("__before") <= most).drop("__cell", "__in", "__before")


def path_key(path: Column) -> Column:
    return F.sha2(path, 256)


def stream_new_files(spark: SparkSession, folder: str, glob: str, sink, checkpoint: str, per_trigger: int = 1_000):
    """Files not seen yet, once through: sink(batch, number) for each micro-batch."""
    held = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return held.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
