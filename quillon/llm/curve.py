"""Packing along a space-filling curve: documents with similar tokens share sequences, and no sequence is padded.

A document's token ids are hashed with signs into BUCKETS counts, damped by the square root and brought to unit length; a fixed
random projection takes that vector to DIMS coordinates. Each coordinate is standardised by its mean and deviation over all
documents and laid on a grid through the logistic function, so cells are filled about evenly; the cell's place along the
Hilbert curve is the document's key. The narrow table (row, key, tokens) is range-sorted by key once, and the ids of all
documents in that order make one stream, of which every `capacity` ids are a sequence. What is left at the stream's end is cut
into powers of two. A document's place in the stream depends on two numbers, so its ids travel once, to their pieces.

Null text is empty: the end id alone. Rows without doc_id, repeated rows and equal texts are documents of their own; equal keys
are ordered by the row's number in the stored table. An empty table gives no piece. Columns other than doc_id and text are not
read. The driver sees 2 * DIMS statistics and one count for each range."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import rank_encoder
from .storage import materialize, named, nameless, small_batches
from .textbatch import mix64, text_slices
from .tokens import ChunkEncoder

BUCKETS, DIMS, BITS = 512, 4, 15
PROJECTION = np.random.default_rng(11).standard_normal((BUCKETS, DIMS))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cells, integers from 0 to 2**bits - 1; bits times columns is at most 63."""
    axes = [c.astype(np.int64) for c in cells.T]
    for q in (1 << b for b in range(bits - 1, 0, -1)):  # undo, from coarse to fine, the turns that the curve takes in each cell
        low = q - 1
        for i, axis in enumerate(axes):
            inside = (axis & q) > 0
            swap = np.where(inside, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(inside, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((axes[-1] & q) > 0, q - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


@cache
def _signed_buckets(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the sign of each id below n."""
    hashed = mix64(np.arange(n, dtype=np.uint64))
    return (hashed % np.uint64(BUCKETS)).astype(np.int32), 1.0 - 2.0 * (hashed >> np.uint64(63))


def points(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """DIMS coordinates of each document, whose ids are ids[offsets[k]:offsets[k + 1]]."""
    n = len(offsets) - 1
    bucket, sign = _signed_buckets(1 << int(ids.max(initial=1)).bit_length())
    cell = np.repeat(np.arange(n, dtype=np.int32) * BUCKETS, np.diff(offsets)) + bucket[ids]
    counts = np.bincount(cell, sign[ids], n * BUCKETS).reshape(n, BUCKETS)
    damped = np.sign(counts) * np.sqrt(np.abs(counts))
    return damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-12) @ PROJECTION


def encoded(docs: DataFrame, tokenizer: str, kind: str, end_id: int, ranks: str | None = None) -> DataFrame:
    """ranks: the same vocabulary's ranks, if they are at hand, for speed. Returns row, doc_id, nameless, n (ids with the end id), ids (little-endian, unsigned 32-bit), point of every row."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = rank_encoder(tokenizer, ranks) if ranks else ChunkEncoder.get(tokenizer, kind)
        for pdf in batches:
            for some in text_slices(pdf, "text"):
                ids, offsets = encoder.encode(some["text"].tolist())
                at = points(ids, offsets)
                own = [np.append(ids[a:b], np.uint32(end_id)).astype("<u4") for a, b in zip(offsets[:-1], offsets[1:])]
                yield some[["row", "doc_id", "nameless"]].assign(n=[len(x) for x in own], ids=[x.tobytes() for x in own], point=list(at))

    small_batches(docs.sparkSession)
    rows = nameless(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInPandas(encode, "row long, doc_id long, nameless boolean, n long, ids binary, point array<double>")


def along_curve(coded: DataFrame) -> DataFrame:
    """row, part, start: the rows of encoded() in ranges of the Hilbert key, and the ids before each in its range."""
    spread = [f(F.col("point")[k]) for k in range(DIMS) for f in (F.avg, F.stddev_pop)]
    found = np.array([x or 0.0 for x in coded.select(*spread).first()]).reshape(DIMS, 2)
    mean, deviation = found[:, 0], np.maximum(found[:, 1], 1e-12)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                z = (np.stack(pdf["point"].to_numpy()) - mean) / deviation
                cells = np.minimum((1 << BITS) / (1 + np.exp(np.clip(-1.702 * z, -50, 50))), (1 << BITS) - 1)
                yield pdf[["row", "n"]].assign(key=hilbert_keys(cells, BITS))

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for pdf in batches:
            ends = before + pdf["n"].cumsum()
            yield pd.DataFrame({"row": pdf["row"], "part": part, "start": ends - pdf["n"], "n": pdf["n"]})
            before = int(ends.iloc[-1]) if len(pdf) else before

    ranges = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = coded.select("row", "n", "point").mapInPandas(keys, "row long, n long, key long")
    ordered = keyed.repartitionByRange(ranges, "key", "row").sortWithinPartitions("key", "row")
    return ordered.mapInPandas(running, "row long, part int, start long, n long")


def curve_pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", capacity: int = 1024, end_id: int = 0, ranks: str | None = None) -> DataFrame:
    """Pack all rows. A row for each piece: doc_id, start (ids of its document before it), length, ids, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    coded = materialize(encoded(docs, tokenizer, kind, end_id, ranks), "curve-ids")
    order = materialize(along_curve(coded), "curve-order")
    totals = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    parts = sorted(totals)
    ends = list(accumulate(totals[p] for p in parts))
    total = ends[-1] if ends else 0
    whole, cuts = total - total % capacity, []
    for b in range(capacity.bit_length() - 1, -1, -1):  # the rest in powers of two, the largest first
        if total % capacity & 1 << b:
            cuts.append((cuts[-1] if cuts else whole) + (1 << b))
    base = spark.createDataFrame([(p, e - totals[p]) for p, e in zip(parts, ends)], "part int, base long")
    placed = order.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("start")).alias("at"))
    at, n = F.col("at"), F.col("n")
    first, last = F.call_function("div", at, F.lit(capacity)), F.call_function("div", at + n - 1, F.lit(capacity))
    within = F.when(last > first, F.transform(F.sequence(first + 1, last), lambda k: k * capacity)).otherwise(F.array().cast("array<long>"))
    rest = F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: (c > at) & (c < at + n))
    bounds = F.concat(F.array(at), within, rest, F.array(at + n))
    docs_at = coded.drop("point").join(placed.hint("shuffle_hash"), "row").withColumn("bounds", bounds)
    start, length = F.col("p.a") - at, F.col("p.b") - F.col("p.a")
    piece = F.zip_with(F.slice("bounds", 1, F.size("bounds") - 1), F.slice("bounds", 2, F.size("bounds") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.substring("ids", ((a - at) * 4 + 1).cast("int"), ((b - a) * 4).cast("int")).alias("ids")))
    beyond = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= F.col("p.a")))
    begins = F.aggregate(F.array(*map(F.lit, [whole, *cuts])).cast("array<long>"), F.lit(0).cast("long"), lambda s, c: F.when(c <= F.col("p.a"), c).otherwise(s))
    in_rest = F.col("p.a") >= whole
    return named(
        docs_at.select("doc_id", "nameless", n.alias("doc_tokens"), "at", F.explode(piece).alias("p")).select(
            "doc_id", "nameless", start.alias("start"), length.alias("length"), "p.ids", "doc_tokens",
            F.when(in_rest, whole // capacity + beyond).otherwise(F.call_function("div", F.col("p.a"), F.lit(capacity))).cast("long").alias("sequence_id"),
            F.when(in_rest, F.col("p.a") - begins).otherwise(F.col("p.a") % capacity).alias("offset"),
        ))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids of every sequence that curve_pieces() filled."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of one sequence: at most its capacity
    return pieces.groupBy("sequence_id").agg(F.aggregate(own, F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"))
