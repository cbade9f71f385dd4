"""Collocations: phrases of two to four words that occur together more than their parts apart, mined through count-min sketches.

Every task counts its phrases in a sketch of DEPTH rows of CELLS saturating counters; sketches of all tasks are merged cell by cell,
so an estimate is never below the true count (or the counters' end, which is above the threshold). A first sketch holds words and
pairs. A second holds only longer phrases all of whose pairs reach the threshold in the first. A last pass counts exactly, by
phrase, what both let through; all frequent phrases are among these, so none is lost, and false ones are counted and go. The sketches
have one size (2 * DEPTH * CELLS bytes in all), whatever the input's, which bounds what is sent to each worker; on a corpus with
many more phrases than cells they let more through, which costs the last pass more rows and changes no result.

Texts are lower-cased in A-Z and split at `.,;:!?` and line ends into pieces, pieces at spaces and tabs into words. All counts are
per lang, null being 'und'. Null and empty texts have no words. Equal texts and repeated rows count each time; doc_id isn't read, nor
any other column. An empty table gives no phrases. Ties in the report are broken by count, then by the phrase's bytes.
Within a task phrases are told apart by 64-bit hashes, between tasks by their texts."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .textbatch import as_bytes, mix64, text_slices, words

LONGEST, LEAST, DEPTH, LOG_CELLS, LOG_STRIPE = 4, 30, 2, 25, 18
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))
_IS_BREAK = np.isin(np.arange(256), list(_BREAKS))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ROWS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]  # an odd factor for each row


class Batch:
    """Words and phrases of some texts. grams[k - 1][i]: hash of lang and the k words from the i-th on; whole[k - 1][i]: whether they lie in one piece."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        raw = [as_bytes(t) for t in texts]
        hashed, start, end, offsets = words([t.translate(_PLAIN) for t in raw])
        before = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))[:-1].astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        self.text, self.start, self.end, self.langs = b"\n".join(raw).lower(), start + before[self.doc], end + before[self.doc], langs
        piece = np.cumsum(_IS_BREAK[np.frombuffer(self.text, np.uint8)], dtype=np.int64)[self.start] if len(hashed) else np.zeros(0, np.int64)
        of_lang = {x: zlib.crc32(as_bytes(x)) + 1 for x in set(langs)}
        seed = mix64(np.array([of_lang[x] for x in langs], np.uint64))
        self.grams, self.whole = [mix64(seed[self.doc] ^ hashed)], [np.ones(len(hashed), bool)]
        for k in range(1, LONGEST):
            n = max(0, len(hashed) - k)
            self.grams.append(mix64(self.grams[-1][:n] * _STEP + hashed[k:]))
            self.whole.append(piece[:n] == piece[k:])

    def phrase(self, i: int, k: int) -> bytes:
        return b" ".join(self.text[a:b] for a, b in zip(self.start[i : i + k].tolist(), self.end[i : i + k].tolist()))


def batches_of(batches: Iterator[pd.DataFrame]) -> Iterator[Batch]:
    for pdf in batches:
        for some in text_slices(pdf, "text", 1_000_000):
            yield Batch(some["text"].tolist(), some["lang"].tolist())


class Sketch:
    def __init__(self, least: int, counters: np.ndarray | None = None):
        self.counters = np.zeros((DEPTH, 1 << LOG_CELLS), np.min_scalar_type(least)) if counters is None else counters

    @staticmethod
    def cells(grams: np.ndarray, row: int) -> np.ndarray:
        return ((grams * _ROWS[row]) >> np.uint64(64 - LOG_CELLS)).astype(np.uint32)

    def add(self, grams: np.ndarray) -> None:
        most = np.iinfo(self.counters.dtype).max
        for row in range(DEPTH):
            cell = np.sort(self.cells(grams, row))
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
            at, many = cell[first], np.diff(np.concatenate((first, [len(cell)])))
            self.counters[row][at] = np.minimum(self.counters[row][at].astype(np.int64) + many, most)

    def reaches(self, grams: np.ndarray, least: int) -> np.ndarray:
        """Whether the estimate is least or more."""
        out = self.counters[0][self.cells(grams, 0)] >= least
        for row in range(1, DEPTH):
            some = np.flatnonzero(out)
            out[some] = self.counters[row][self.cells(grams[some], row)] >= least
        return out

    def stripes(self) -> Iterator[pd.DataFrame]:
        """Rows (stripe, cells) of all stripes that hold a count."""
        for k, stripe in enumerate(self.counters.reshape(-1, 1 << LOG_STRIPE)):
            if stripe.any():
                yield pd.DataFrame({"stripe": [k], "cells": [zlib.compress(stripe.tobytes(), 1)], "lang": [None], "n": [0]})


def chained(batch: Batch, pairs: Sketch, least: int) -> list[np.ndarray]:
    """For two words and more, whether a phrase lies in one piece and all its pairs reach least."""
    out = [np.zeros(len(batch.whole[1]), bool)]
    some = np.flatnonzero(batch.whole[1])
    out[0][some] = pairs.reaches(batch.grams[1][some], least)
    for k in range(3, LONGEST + 1):
        n = len(batch.whole[k - 1])
        out.append(out[-1][:n] & out[0][k - 2 : k - 2 + n])
    return out


def merged(sketches: DataFrame, least: int) -> dict[int, bytes]:
    """The compressed stripes of the sum of all tasks' sketches, which add up stripe by stripe in streams: a stripe's many parts never lie in memory together."""
    kind = np.min_scalar_type(least)
    most = np.iinfo(kind).max

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, cells in zip(pdf["stripe"].tolist(), pdf["cells"]):
                part = np.frombuffer(zlib.decompress(cells), kind)
                sums[k] = part if k not in sums else np.where(part > most - sums[k], most, part + sums[k]).astype(kind)
        for k, cells in sums.items():
            yield pd.DataFrame({"stripe": [k], "cells": [zlib.compress(cells.tobytes(), 1)]})

    parts = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sketches.where("stripe >= 0").select("stripe", "cells").repartition(parts, "stripe").mapInPandas(merge, "stripe int, cells binary")
    return {r["stripe"]: bytes(r["cells"]) for r in rows.collect()}  # at most the sketch's stripes


@contextmanager
def sent(spark: SparkSession, *sketches: dict[int, bytes]) -> Iterator[list]:
    """The sketches as broadcasts: at most DEPTH * CELLS counters each, whatever the input."""
    held = [spark.sparkContext.broadcast((uuid.uuid4().hex, stripes)) for stripes in sketches]
    yield held
    for b in held:
        b.unpersist()


_OPEN: dict[str, np.ndarray] = {}  # of a worker: the sketches it used last


def opened(broadcast, least: int) -> Sketch:
    name, stripes = broadcast.value
    if name not in _OPEN:
        while len(_OPEN) > 1:
            del _OPEN[next(iter(_OPEN))]
        _OPEN[name] = np.zeros((DEPTH << (LOG_CELLS - LOG_STRIPE), 1 << LOG_STRIPE), np.min_scalar_type(least))
        for k, cells in stripes.items():
            _OPEN[name][k] = np.frombuffer(zlib.decompress(cells), _OPEN[name].dtype)
    return Sketch(least, _OPEN[name].reshape(DEPTH, -1))


def close_all() -> None:
    _OPEN.clear()


SKETCH = "stripe int, cells binary, lang string, n long"


def sketch_pairs(docs: DataFrame, least: int) -> DataFrame:
    """Every task's sketch of words and pairs; rows with lang and n: its words (stripe -1)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        close_all()  # of an earlier corpus
        sketch, n = Sketch(least), {}
        for b in batches_of(batches):
            sketch.add(np.concatenate((b.grams[0], b.grams[1][b.whole[1]])))
            for doc, many in enumerate(np.bincount(b.doc, minlength=len(b.langs)).tolist()):
                n[b.langs[doc]] = n.get(b.langs[doc], 0) + many
        yield from sketch.stripes()
        yield pd.DataFrame({"stripe": -1, "cells": None, "lang": list(n), "n": list(n.values())})

    return docs.mapInPandas(count, SKETCH)


def sketch_longer(docs: DataFrame, pairs, least: int) -> DataFrame:
    """Every task's sketch of longer phrases all of whose pairs reach least in the broadcast sketch of pairs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, first = Sketch(least), opened(pairs, least)
        for b in batches_of(batches):
            sketch.add(np.concatenate([g[ok] for g, ok in zip(b.grams[2:], chained(b, first, least)[1:])]))
        yield from sketch.stripes()

    return docs.mapInPandas(count, SKETCH)


class Counts:
    """Counts of phrases by hash. The phrases lie behind each other in one buffer: some 60 bytes each in all."""

    def __init__(self):
        self.grams, self.counts, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.text, self.ends, self.size, self.lang = bytearray(), array("q", [0]), array("b"), array("h")
        self.langs: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.size)

    def add(self, batch: Batch, k: int, through: np.ndarray) -> None:
        """The phrases of k words for which through holds."""
        place = np.flatnonzero(through)
        grams, first, many = np.unique(batch.grams[k - 1][place], return_index=True, return_counts=True)
        at = np.searchsorted(self.grams, grams)
        known = np.zeros(len(grams), bool)
        known[at < len(self.grams)] = self.grams[at[at < len(self.grams)]] == grams[at < len(self.grams)]
        self.counts[at[known]] += many[known]
        numbers = len(self) + np.arange((~known).sum(), dtype=np.int32)
        for i in place[first[~known]].tolist():
            self.text += batch.phrase(i, k)
            self.ends.append(len(self.text))
            self.lang.append(self.langs.setdefault(batch.langs[batch.doc[i]], len(self.langs)))
        self.size.extend([k] * len(numbers))
        both = np.concatenate((self.grams, grams[~known]))
        sort = np.argsort(both, kind="stable")
        self.grams, self.counts, self.order = both[sort], np.concatenate((self.counts, many[~known]))[sort], np.concatenate((self.order, numbers))[sort]

    def frames(self, size: int = 50_000) -> Iterator[pd.DataFrame]:
        counts, names = np.zeros(len(self), np.int64), list(self.langs)
        counts[self.order] = self.counts
        for k in range(0, len(self), size):
            n = min(len(self), k + size)
            phrases = [self.text[a:b].decode("utf-8", "replace") for a, b in zip(self.ends[k:n], self.ends[k + 1 : n + 1])]
            yield pd.DataFrame({"lang": [names[i] for i in self.lang[k:n]], "size": self.size[k:n].tolist(), "phrase": phrases, "a": counts[k:n]})


def count_survivors(docs: DataFrame, pairs, longer, least: int, most: int = 1_200_000) -> DataFrame:
    """lang, size, phrase, a of each task: exact counts of all phrases that the sketches let through, sent on when `most` are held."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second, held = opened(pairs, least), opened(longer, least), Counts()
        for b in batches_of(batches):
            through = [first.reaches(b.grams[0], least), *chained(b, first, least)]
            for k in range(3, LONGEST + 1):
                some = np.flatnonzero(through[k - 1])
                through[k - 1][some] = second.reaches(b.grams[k - 1][some], least)
            for k, ok in enumerate(through, 1):
                held.add(b, k, ok)
            if len(held) >= most:
                yield from held.frames()
                held = Counts()
        yield from held.frames()

    return docs.mapInPandas(count, "lang string, size int, phrase string, a long")


def in_large_tasks(docs: DataFrame) -> DataFrame:
    """Every task makes a sketch of its own and sends each of its phrases once: as many tasks as two for each core, or one for each 16 partitions."""
    parts = docs.rdd.getNumPartitions()
    return docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, parts // 16)) if parts else docs


def frequent_phrases(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a of every phrase of one to four words that occurs least times or more; lang, n words). Both are stored."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = in_large_tasks(documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))
    sketches = materialize(sketch_pairs(docs, least), "sketches-pairs")
    totals = sketches.where("stripe < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = merged(sketches, least)
    with sent(spark, pairs) as (p,):
        longer = merged(materialize(sketch_longer(docs, p, least), "sketches-longer"), least)
    with sent(spark, pairs, longer) as (p, q):
        counts = count_survivors(docs, p, q, least).groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
        return materialize(counts, "phrases"), totals


def _part(array: str, first, length):
    return F.array_join(F.slice(array, first, length), " ")


def without_subsumed(phrases: DataFrame) -> DataFrame:
    """Candidates (two words and more) but those within a longer one with 100 * f(longer) >= 80 * a."""
    split = phrases.where("size >= 3").select("lang", "a", "size", F.split("phrase", " ").alias("w"))
    spans = [(i, k) for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2)]
    parts = F.array(*[F.when(F.lit(i + k - 1) <= F.col("size"), F.when(F.lit(k) < F.col("size"), _part("w", i, k))) for i, k in spans])
    longest = split.select("lang", "a", F.explode(parts).alias("phrase")).where("phrase is not null").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = phrases.where("size >= 2").join(longest, ["lang", "phrase"], "left")
    return found.where(F.expr("longer is null or CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * 80")).drop("longer")


def scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Add l, r and score of the lowest-scoring cut; ties go to the shortest first part."""
    cuts = candidates.select("lang", "phrase", "a", "size", F.split("phrase", " ").alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("first"), _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = phrases.select("lang", "phrase", "a")
    both = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    cut = both.withColumn("score", F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (l + r)"))
    return cut.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c")).select("lang", "phrase", "a", "c.*")


def collocations(documents: DataFrame, least: int = LEAST, report: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `report` of each lang by score, count and phrase."""
    phrases, totals = frequent_phrases(documents, least)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = scored(without_subsumed(phrases), phrases).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = rows.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_at") <= report)  # at most 64 reports of a lang meet
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= report)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
