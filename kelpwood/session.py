"""Session helpers shared by all operators: tables, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory (a parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in spark.checkpoint.dir. Only where that is unset, as in
    local tests, a folder of this machine is used."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="kelpwood-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{_shared_folder(spark)}/{uuid.uuid4()}"


MOST_BYTES = 64 << 20  # of what is broadcast


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def _bytes(name: str, kind: T.DataType) -> Column:
    """About the bytes a column takes in a row, nested lists included."""
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col.alias("v")))), F.lit(0)).cast("bigint") + 16  # at least of that order
    return F.lit(16).cast("bigint")


def broadcast_if_small(df: DataFrame, rows: int, most: int = MOST_BYTES) -> DataFrame:
    """A broadcast hint if df is proven to have at most so many rows and bytes, else df as it is. Store df before, if it
    is dear to make: it is read for the proof."""
    size = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= most else df


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """df with ``place``: 0, 1, .. in the given order, by range partitions and their counts."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    before = kept.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))
    before = F.broadcast(before.select("__part", "__first", "__before"))  # one row a partition
    return kept.join(before, "__part").withColumn("place", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def parallelism(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
