"""A stored positional index: documents are tokenised once, queries read postings, dictionary and stored columns.

Postings are bucketed by document and sorted by field and term within each bucket. All postings of a document lie in one
bucket, so scores, conjunctions and phrases are computed inside buckets without an exchange, only each bucket's best rows
travel, and a term that a third of all documents hold is spread like any other. Term filters prune row groups by the sort
order. Stored columns (filters) are bucketed alike, so they join without an exchange. The dictionary holds document frequency and the
largest term-frequency part of every term: upper bounds for pruning.

A stemmed index is derived from the plain one: terms are stemmed where they stand and positions merged within buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.stem import stem_of
from ..functions.text import tokens
from ..sources.tables import file_state, shared_dir
from .retrieval import K1, B


SHARD_BYTES, MOST_SHARDS = 8 << 20, 100_000  # of the table's files in a bucket, about, so that a bucket is sorted and scored in memory; buckets that Spark allows


@dataclass(frozen=True)
class Index:
    """postings: key, field, term, tf, dl, gaps (first position, then differences); terms: field, term, df, tf, top; fields: field, n_docs, avgdl, tokens; rows: key and stored columns."""

    key: str
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    rows: DataFrame


def gaps(positions: Column) -> Column:
    """Ascending positions as the first and the differences."""
    return F.transform(positions, lambda p, i: F.when(i == 0, p).otherwise(p - F.get(positions, i - 1)))


def positions(gaps_: Column) -> Column:
    """Undo gaps()."""
    total = F.aggregate(gaps_, F.array().cast("array<int>"), lambda done, g: F.concat(done, F.array(g + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)))))
    return F.when(F.size(gaps_) == 1, gaps_).otherwise(total)


def postings_of(lists: Column) -> Column:
    """(term, dl, gaps) of each term of a document, from the token lists of its rows: sorted within the document, so tokens are never rows of a table."""
    places = F.flatten(F.transform(F.filter(lists, lambda ts: ts.isNotNull()), lambda ts: F.transform(ts, lambda t, i: F.struct(t.alias("term"), i.alias("pos"), F.size(ts).alias("dl")))))

    def marked(s: Column) -> Column:
        """Whether a place is its term's first, and its distance from the one before."""
        same = lambda x, i: F.get(s, i - 1)["term"].eqNullSafe(x["term"])
        return F.transform(s, lambda x, i: F.struct(x["term"].alias("term"), x["dl"].alias("dl"), F.when(~same(x, i), i).alias("first"), F.when(same(x, i), x["pos"] - F.get(s, i - 1)["pos"]).otherwise(x["pos"]).alias("gap")))

    def cut(s: Column) -> Column:
        starts = F.filter(s["first"], lambda i: i.isNotNull())
        one = lambda at, b, j: F.struct(F.get(s, b)["term"].alias("term"), F.get(s, b)["dl"].alias("dl"), F.slice(s, b + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - b)["gap"].alias("gaps"))
        return once(starts, lambda at: F.transform(at, lambda b, j: one(at, b, j)))

    return once(once(F.sort_array(places), marked), cut)


def tf_part(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _save(df: DataFrame, name: str, path: str, key: str, shards: int, *order: str) -> None:
    df.write.format("parquet").bucketBy(shards, key).sortBy(*order).option("path", path).mode("overwrite").saveAsTable(name)


def _finish(spark: SparkSession, name: str, path: str, key: str) -> Index:
    """Dictionary and field statistics from the stored postings."""
    post = spark.table(f"{name}_postings")
    lengths = post.groupBy(key, "field").agg(F.first("dl").alias("dl"))  # inside buckets
    lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("tokens")).write.mode("overwrite").parquet(f"{path}/fields")
    fields = spark.read.parquet(f"{path}/fields")  # a row for each field
    top = F.max(tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("top")
    post.join(F.broadcast(fields.select("field", "avgdl")), "field").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), top).write.mode("overwrite").parquet(f"{path}/terms")
    return Index(key, post, spark.read.parquet(f"{path}/terms"), fields, spark.table(f"{name}_rows"))


def write_index(docs: DataFrame, key: str, fields: Mapping[str, Column], stored: Sequence[Column | str], name: str, path: str, shards: int) -> Index:
    """Null texts have no tokens. Rows that share a key are one document with the tokens of all."""
    spark = docs.sparkSession
    _save(docs.select(key, *stored).repartition(shards, key), f"{name}_rows", f"{path}/rows", key, shards, key)
    rows = docs.select(key, F.struct(*(c.alias(n) for n, c in fields.items())).alias("of")).repartition(shards, key)  # texts travel once, to where their postings stay
    whole = rows.groupBy(key).agg(F.collect_list("of").alias("of"))
    each = whole.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("field"), postings_of(F.transform(f"of.{n}", tokens)).alias("p")) for n in fields))).alias("f"))
    flat = each.select(key, "f.field", F.explode("f.p").alias("p")).select(key, "field", "p.term", F.size("p.gaps").alias("tf"), "p.dl", "p.gaps")
    _save(flat, f"{name}_postings", f"{path}/postings", key, shards, "field", "term")
    return _finish(spark, name, path, key)


def write_stemmed(plain: Index, name: str, path: str, shards: int) -> Index:
    """The index of English stems. Positions and lengths stay those of the words."""
    spark, key = plain.postings.sparkSession, plain.key
    stem = plain.postings.withColumn("term", stem_of("term")).repartition(shards, key)  # the dictionary may be too large to send everywhere
    at = stem.groupBy(key, "field", "term").agg(F.sort_array(F.flatten(F.collect_list(positions(F.col("gaps"))))).alias("at"), F.first("dl").alias("dl"))
    _save(at.select(key, "field", "term", F.size("at").alias("tf"), "dl", gaps(F.col("at")).alias("gaps")), f"{name}_postings", f"{path}/postings", key, shards, "field", "term")
    _save(plain.rows, f"{name}_rows", f"{path}/rows", key, shards, key)
    return _finish(spark, name, path, key)


_OPEN: dict[tuple[str, str], Index] = {}  # of this application


def open_index(docs: DataFrame, key: str, fields: Mapping[str, Column], stored: Sequence[Column | str] = (), analyzer: str = "none", shards: int | None = None) -> Index:
    """The index of a table read from files, written when it is first asked for and again when its files change."""
    spark, state = docs.sparkSession, file_state(docs)
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    shards = shards or min(MOST_SHARDS, max(few, sum(size for _, size, _ in state) // SHARD_BYTES))
    about = [state, key, sorted((n, str(c)) for n, c in fields.items()), [str(c) for c in stored], shards]
    name = f"quillon_{hashlib.sha256(repr(about).encode()).hexdigest()[:20]}"
    app = spark.sparkContext.applicationId
    if (app, name) not in _OPEN:
        _OPEN[app, name] = write_index(docs, key, fields, stored, name, f"{shared_dir(spark)}/quillon-index/{name}", shards)
    if analyzer == "none":
        return _OPEN[app, name]
    if analyzer != "english":
        raise ValueError(f"no analyzer {analyzer}")
    if (app, f"{name}_en") not in _OPEN:
        _OPEN[app, f"{name}_en"] = write_stemmed(_OPEN[app, name], f"{name}_en", f"{shared_dir(spark)}/quillon-index/{name}_en", shards)
    return _OPEN[app, f"{name}_en"]


def conjunctive(index: Index, terms: Sequence[str], field: str) -> DataFrame:
    """Documents whose field holds every term."""
    held = index.postings.where((F.col("field") == field) & F.col("term").isin(*set(terms)))
    return held.groupBy(index.key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(terms))).select(index.key)


def phrase(index: Index, terms: Sequence[str], field: str) -> DataFrame:
    """(key, n): documents in which the terms follow each other, and how often. Positions are decoded for documents with all terms alone."""
    held = index.postings.where((F.col("field") == field) & F.col("term").isin(*set(terms)))
    lists = held.groupBy(index.key).agg(F.collect_list(F.struct("term", "gaps")).alias("of")).where(F.size("of") == len(set(terms)))

    def starts(k: int, term: str) -> Column:
        """Where the phrase begins if this is its k-th term."""
        return F.transform(positions(F.element_at(F.filter("of", lambda x: x["term"] == term), 1)["gaps"]), lambda p: p - k)

    met = reduce(F.array_intersect, (starts(k, t) for k, t in enumerate(terms)))
    return lists.select(index.key, F.size(met).alias("n")).where("n > 0")
