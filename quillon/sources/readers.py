"""Sources and sinks of catalog data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version 1 of a scraped record.
SCRAPED = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("brand", "name", "product_url")]
    + [T.StructField(n, T.StringType()) for n in ("description", "material")]
    + [T.StructField("price_cents", T.IntegerType()), T.StructField("image_urls", T.ArrayType(T.StringType())), T.StructField("scraped_at", T.StringType()), T.StructField("size_range", T.ArrayType(T.StringType())), T.StructField("model_height_cm", T.IntegerType())]
)


def latest_run(spark: SparkSession, root: str, stores: tuple[str, ...] = ("images",)) -> str:
    """The greatest directory, by name, that holds a product file; image stores and stray files are passed over. Fails if there is none.

    Hadoop lists the files; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_products.json").load(root)
    folders = found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("path"))
    run = folders.where(~F.col("run").isin(*stores)).agg(F.max(F.struct("run", "path")).alias("r")).first()["r"]
    if run is None:
        raise FileNotFoundError(f"no run in {root}")
    return run["path"]


def read_run(spark: SparkSession, path: str, brands: list[str] | None = None) -> DataFrame:
    """JSON arrays of one run, `<brand>_products.json`; a file is skipped by name, a row of another brand than its file's fails."""
    glob = f"{path}/{{{','.join(brands)}}}_products.json" if brands else f"{path}/*_products.json"
    rows = spark.read.schema(SCRAPED).option("multiLine", True).option("mode", "FAILFAST").json(glob)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_products\.json$", 1)
    wrong = F.when(F.coalesce(F.col("brand") != named, F.lit(True)) | (F.trim("name") == "") | (F.trim("product_url") == ""), F.raise_error(F.concat(F.lit("bad row in "), F.col("_metadata.file_name")))).otherwise(F.col("brand"))
    return rows.withColumn("brand", wrong)


def write_run(df: DataFrame, path: str) -> None:
    """One JSON-lines folder per brand under the run's path."""
    df.write.mode("error").partitionBy("brand").json(path)


def store_content(content: DataFrame, key: str, column: str, path: str) -> dict[str, int]:
    """Keep each distinct blob once under its SHA-256 and link keys to it; returns counts: added, linked, missing (rows without content).

    path/blobs has id and content, path/links key and id. Blobs are written before links, each by one committed job, and both only for what
    isn't there, so a run that broke off is completed by the next and a repeated one writes nothing. A key that is linked to
    other content, here or in the store, stops the run before anything is written."""
    spark = content.sparkSession
    rows = content.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.sha2(F.col(column).cast("binary"), 256).alias("id"), F.col(column).cast("binary").alias("content"))
    pairs = rows.select("key", "id").distinct()
    links, blobs = (_stored(spark, f"{path}/{name}", schema) for name, schema in (("links", pairs.schema), ("blobs", rows.select("id", "content").schema)))
    clash = pairs.union(links).groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"key {clash[0]['key']} is linked to several contents")
    fresh = rows.select("id", "content").join(blobs.select("id"), "id", "left_anti").dropDuplicates(["id"])
    unlinked = pairs.join(links, ["key", "id"], "left_anti")
    counts = {"added": _append(fresh, f"{path}/blobs"), "linked": _append(unlinked, f"{path}/links"), "missing": content.where(F.col(column).isNull()).count()}
    return counts


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def _append(rows: DataFrame, path: str) -> int:
    """Append rows and return their number; nothing is written if there are none."""
    if rows.isEmpty():
        return 0
    seen = Observation("appended")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def append_summary(summary: DataFrame, path: str) -> None:
    """A line for each row of a run's summary, behind those of earlier runs."""
    summary.write.mode("append").json(path)
