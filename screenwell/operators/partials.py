"""Stored partial aggregates: sums per key, merged partition by partition as new results come in.

A table of partials is a Parquet folder with one partition per period.  Merging a batch reads and rewrites the periods
the batch has rows of, by dynamic partition overwrite, and no others.  Each period carries the number of the last batch
merged into it: a batch that is repeated after a failure, in whole or in part, only reaches the periods it had
not reached.  Batches of one table must come one after the other, with growing numbers, as `foreachBatch` gives them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD, BATCH = "period", "last_batch"


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The partials at `path`, with the columns of `like`; none where nothing was merged yet."""
    schema = like.withColumns({BATCH: F.lit(0).cast("long"), PERIOD: F.lit("")}).schema
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def summed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of the columns but `keys`, in their types.

    The rows are dealt anew first: where they come from an aggregate, one task would otherwise hold its groups and these together.
    """
    dealt = rows.withColumn("_deal", F.xxhash64(*keys)).hint("rebalance", F.col("_deal")).drop("_deal")
    return dealt.groupBy(*keys).agg(*[F.sum(c).cast(f.dataType).alias(c) for c, f in zip(rows.columns, rows.schema) if c not in keys])


def merge(path: str, new: DataFrame, keys: Sequence[str], period: Column, batch: int) -> list[str]:
    """Add the sums of `new` (its columns but `keys`) to those stored; returns the periods rewritten.

    `period` is a string of the keys, such as a day.  What comes to the driver are the periods of one batch.
    `new` is read twice, for the periods and for the sums, and summed together with what is stored: it should come as partials
    that are cheap to read again, written ones where the results behind them are not.
    """
    fresh = new.withColumn(PERIOD, F.coalesce(period, F.lit("none")))
    periods = sorted(r[0] for r in fresh.select(PERIOD).distinct().collect())
    old = stored(new.sparkSession, path, new).filter(F.col(PERIOD).isin(periods))
    done = {r[0] for r in old.groupBy(PERIOD).agg(F.max(BATCH).alias("b")).filter(F.col("b") >= batch).select(PERIOD).collect()}
    todo = [p for p in periods if p not in done]
    if not todo:
        return []
    both = old.drop(BATCH).unionByName(fresh).filter(F.col(PERIOD).isin(todo))
    (summed(both, [*keys, PERIOD]).select(*new.columns, F.lit(batch).cast("long").alias(BATCH), PERIOD).hint("rebalance", F.col(PERIOD))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path))
    return todo


def read(spark: SparkSession, path: str) -> DataFrame:
    """The merged partials, without the bookkeeping columns."""
    return spark.read.parquet(path).drop(BATCH, PERIOD)
