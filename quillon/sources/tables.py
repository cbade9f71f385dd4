"""Tables that the library writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once; its size on disk is known to the planner from then on."""
    path = f"{shared_dir(df.sparkSession)}/quillon-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by a key, before work that takes long for each: the files of a small table are one or two tasks, whatever their rows cost."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def file_state(table: DataFrame) -> list[tuple[str, int, str]]:
    """Path, size and time of change of the files behind a table read from files: equal as long as its rows are."""
    rows = table.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").cast("string").alias("t")).distinct().collect()  # a row for each file
    return sorted((r["p"], r["s"], r["t"]) for r in rows)
