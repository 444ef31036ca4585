"""Readers, normalisers and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT_SCHEMA = T.StructType([
    T.StructField("content_id", T.LongType()), T.StructField("content", T.StringType()),
    T.StructField("context_type", T.StringType()), T.StructField("trace_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
RULE_SCHEMA = "array<struct<condition:string,action:string,priority:int>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data set."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_content(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Content rows in the layout of `CONTENT_SCHEMA`; missing columns become null."""
    reader = spark.read.schema(CONTENT_SCHEMA)
    return normalise_content(reader.json(path) if fmt == "json" else spark.read.format(fmt).load(path))


def normalise_content(df: DataFrame) -> DataFrame:
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CONTENT_SCHEMA.fields])


def read_conversation(df: DataFrame, role: str | None = None) -> DataFrame:
    out = df.select("conv_id", "turn", "role", "text")
    return out if role is None else out.filter(F.col("role") == role)


def read_jdbc(spark: SparkSession, url: str, table_name: str, column: str | None = None, low: object = None, high: object = None,
              parts: int = 16, **options: str) -> DataFrame:
    """Relational table over JDBC; filters and columns are pushed down by Spark.

    With `column` (a number, date or time, such as a key or a creation time) and its bounds, `parts` tasks read a range each over
    connections of their own; rows beyond the bounds are in the first and last range.
    """
    if column is not None:
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table_name, **options).load()


# -- JSON columns --------------------------------------------------------------


def json_map(c: Column, value: str = "string") -> Column:
    """JSON object as a map; bad or absent JSON gives an empty map."""
    return F.coalesce(F.from_json(c, f"map<string,{value}>", {"mode": "PERMISSIVE"}),
                      F.create_map().cast(f"map<string,{value}>"))


def json_rules(c: Column) -> Column:
    return F.coalesce(F.from_json(c, RULE_SCHEMA), F.array().cast(RULE_SCHEMA))


def json_tags(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


# -- sinks -----------------------------------------------------------------------


def write_results(df: DataFrame, path: str, date_col: str = "date", mode: str = "append") -> None:
    """Result rows as Parquet, one folder per day.

    Rows are clustered by day and dealt out by size, so a busy day is written by as
    many tasks as it fills and a quiet one into one file.
    """
    df.hint("rebalance", F.col(date_col)).write.mode(mode).partitionBy(date_col).parquet(path)


def write_incidents(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Append audit rows; rows without endpoint, method or address go to a partition of their own.

    One pass and one commit: `side=stored` and `side=rejected` below `path` appear together or not at all.
    """
    ok = F.col("endpoint").isNotNull() & F.col("http_method").isNotNull() & F.col("ip_address").isNotNull()
    df.withColumn("side", F.when(ok, "stored").otherwise("rejected")).write.mode("append").partitionBy("side").parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where driver and executor are one process."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder (any file system Spark knows)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches read, and read it back.

    The branches share one computation, lineage is cut, and a lost executor
    costs no more than re-reading files.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
