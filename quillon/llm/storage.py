"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillon_path = path
    return out


def broadcast_if_few(table: DataFrame, items: int, most: int = 300_000) -> DataFrame:
    """table, to be broadcast if it holds `most` items (of 16 bytes or so) at most; beyond that joins exchange both sides."""
    return F.broadcast(table) if items <= most else table


def drop(table: DataFrame) -> None:
    """Delete a table that materialize() made, once all that read it has been written."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.quillon_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let at most `rows` rows travel to Python at once from now on: rows hold whole texts here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def nameless(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id (0 where null), nameless (whether it was) and columns, text unless given: integers stay integers in pandas only without nulls."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), *(columns or ("text",)))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores behind it, whatever df has no column of."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def named(rows: DataFrame) -> DataFrame:
    """Undo nameless()."""
    return rows.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
