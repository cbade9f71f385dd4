"""Search fields of a catalog, recomputed for the rows whose inputs have changed, in batches or from a stream that can be resumed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.arrays import expand
from ..functions.text import truncate_words
from ..sources.tables import stored

BODY = 600


def _words(*texts: Column) -> Column:
    """Texts that aren't blank, joined in lower case."""
    return F.lower(F.concat_ws(" ", *(F.when(F.trim(t) != "", t) for t in texts)))


def search_fields(name: Column, variant: Column, facets: Sequence[Column], lists: Sequence[Column], material: Column, fibers: Column, fabrics: Column, description: Column, notes: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """A struct title, attrs, material, body: the name; all facets with their synonyms; the composition with the synonyms of its fibres and fabrics; up to 600 characters of copy, cut at a space."""
    none = F.array().cast("array<string>")
    values = F.filter(F.concat(F.array(*facets), *(F.coalesce(x, none) for x in (*lists, fabrics))), lambda v: v.isNotNull())
    joined = lambda a: F.array_join(expand(a, synonyms), " ")
    copy = F.trim(F.regexp_replace(F.concat_ws(" ", F.when(description != "", description), F.when(notes != "", notes)), r"\s+", " "))
    return F.struct(
        _words(name, variant).alias("title"), F.lower(joined(values)).alias("attrs"), _words(material, joined(F.coalesce(fibers, none)), joined(F.coalesce(fabrics, none))).alias("material"), F.lower(truncate_words(copy, BODY)).alias("body"),
    )


@dataclass(frozen=True)
class Refreshed:
    """rows: key, _input (hash of the inputs) and what is derived; computed: how many rows were."""

    rows: DataFrame
    computed: int


def refresh(held: DataFrame | None, inputs: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Derived rows of all inputs: those whose inputs hash as before are kept, the others derived; rows without inputs go.

    held: rows of an earlier refresh, or None. derive: from inputs to key and derived columns, a row for each. Keys must be unique; a null key is never held."""
    columns = [c for c in inputs.columns if c != key]
    hashed = inputs.withColumn("_input", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    changed = hashed if held is None else hashed.join(held.select(key, "_input"), [key, "_input"], "left_anti")
    table = stored(derive(changed.drop("_input")).join(changed.select(key, "_input"), key), "fresh")
    if held is None:
        return Refreshed(table, table.count())
    kept = held.join(hashed.select(key, "_input"), [key, "_input"], "left_semi")
    return Refreshed(table.unionByName(kept.select(table.columns)), table.count())


def backfill(stream: DataFrame, derive: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Derive all that a stream has now, batch by batch, and end. A run that broke off goes on with its first batch that isn't committed.

    Each batch is a folder of its own, which a repeated batch replaces, so no row is there twice. Read the rows with read_backfill()."""

    def write(batch: DataFrame, number: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_backfill(like: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of a backfill; of rows with one key that of the latest batch. like: a table with the derived schema."""
    rows = like.sparkSession.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in like.dtypes)}, batch long").parquet(path)
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "batch").alias("r"))
    return latest.select(key, "r.*").drop("batch")
