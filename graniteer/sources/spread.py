"""Small inputs over all cores: a row group cannot be split, so few files mean few tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A core's share of an input that is large enough to be left as it is: one default split.
SPLIT_BYTES = 128 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by `keys` if it comes from fewer files than there are cores and is under a split for each core; else df.

    A large input is never shuffled for this. The rows are the same in either case.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if cores < 2 or size >= cores * SPLIT_BYTES or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores, *keys)
