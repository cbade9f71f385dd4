"""Exact set-similarity join on word n-grams with vertical partitioning, and the groups that its links form.

1. Equal sets are one class, so copies cost nothing later. 2. A class that links to another shares ceil(t*n) of its n shingles,
so of the shingles below a fixed hash threshold it may miss n - ceil(t*n) at most; classes that miss more end here, and need no
further shuffle. 3. For the rest, document frequency gives the global order, shingles of one class are dropped (they count as
missed), and the order is cut into fragments. 4. Prefixes of the order give candidates, in rounds. In the first a class meets the
heads of its prefix lists, the most central classes of the largest groups; in each later one its next AHEAD in the lists, cut by
some bits of the parity signatures and put in order by others, other bits each time. The BEST nearest of them are tried. Groups
that link are contracted, and lists that hold one group alone leave. Once a round adds few links, or the pairs left are no
more than the postings, all pairs whose groups still differ are tried, so a group of near copies never makes all its pairs.
Candidates are only pairs that the places of their first shared shingle and their parity signatures allow to link.
5. The overlap of a candidate is counted in each fragment by itself and summed per pair; the sum decides exactly.

Rows without words or text are linked with nothing. A row without doc_id keeps its set's size; its component is null."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, materialize, small_batches
from .textbatch import as_bytes, shingles, text_slices, words
from .tokens import forget

FRAGMENTS, BEST, AHEAD = 2, 2, 2
FEW = 8  # a round that links less than one in so many of all that rounds linked is the last one
STEPS = 2  # of pointer jumping between rounds
SPAN = 4096  # postings of one list that are put in order together, about
WORDS = 4  # of 64 bits in a parity signature
BUCKET = 2_000_000  # sampled shingles that a task compares at once


def sets(pdf: pd.DataFrame, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, _, _, offsets = words([as_bytes(t) for t in pdf["text"]])
    values, ends = shingles(h, offsets, width)
    return [np.unique(values[ends[k] : ends[k + 1]]) for k in range(len(pdf))]


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def components(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(id, component) for the ids of undirected edges (a, b): the least id that can be reached. Pointer jumping between rounds.

    After `steps` of them, if given, the least id that was reached by then: equal components are still connected."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    held, taken = labels, 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        new = materialize(step.join(jump, "mid", "left").select("id", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        drop(held)
        held, labels, taken = new, new.select("id", "component"), taken + 1
        if taken == steps or not new.where("component <> old").limit(1).count():
            return labels


def _classes(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n, key of the set, class (the first 8 bytes of the key), need: how many sampled shingles must be shared."""
    limit = _sample(num, den)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in batches:
            for some in text_slices(pdf, "text"):
                own = sets(some, width)
                keys = [_digest(v) for v in own]
                need = [int(np.searchsorted(v, limit)) - _missable(len(v), num, den) for v in own]
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "n": [len(v) for v in own], "key": keys, "class": [_class(k) for k in keys], "need": need})

    return docs.mapInPandas(digest, "doc_id long, n long, key binary, class long, need long")


def _class(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _sample(num: int, den: int) -> np.uint64:
    """Hashes below it are the sample: so large a share that a class must have three quarters of its sampled shingles shared."""
    return np.uint64(int(min(1.0, 4 * (den - num) / den) * (2**64 - 1)))


def _missable(n, num: int, den: int):
    return n - -(-n * num // den)


def _shared(docs: DataFrame, width: int, num: int, den: int, total: int) -> DataFrame:
    """class, shared: how many of each class's sampled shingles other classes have. total: shingles of all documents."""
    spark, limit = docs.sparkSession, _sample(num, den)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, int(total * (int(limit) / 2**64)) // BUCKET)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in batches:
            for some in text_slices(pdf, "text"):
                seen, values, owner, keys = set(), [], [], []
                for v in sets(some, width):
                    if not len(v) or (k := _digest(v)) in seen:
                        continue
                    seen.add(k)
                    own = v[v < limit]  # of every class: also those that need none are partners of others
                    if len(own):
                        owner.append(np.full(len(own), len(keys), np.uint32))
                        values.append(own)
                        keys.append(_class(k))
                if not keys:
                    continue
                value, who = np.concatenate(values), np.concatenate(owner)
                order = np.argsort(value)
                value, who = value[order], who[order]
                cuts = np.searchsorted(value, np.array([int(limit) * k // buckets for k in range(1, buckets)], np.uint64))
                table = np.array(keys, np.int64)
                rows = []
                for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(value)])):
                    if b > a:
                        mine, at = np.unique(who[a:b], return_inverse=True)
                        step = np.diff(value[a:b], prepend=np.uint64(0))
                        rows.append((k, table[mine].tobytes(), at.astype("<u2" if len(mine) < 65536 else "<u4").tobytes(), step.view(np.uint8).reshape(-1, 8).T.tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "classes", "at", "steps"])

    blobs = docs.mapInPandas(emit, "bucket int, classes binary, at binary, steps binary")

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        value, who = [], []
        for classes, at, steps in zip(pdf["classes"], pdf["at"], pdf["steps"]):
            n = len(steps) // 8
            value.append(np.cumsum(np.frombuffer(steps, np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64))
            who.append(np.frombuffer(classes, np.int64)[np.frombuffer(at, "<u2" if len(at) == 2 * n else "<u4")])
        value, who = np.concatenate(value), np.concatenate(who)
        order = np.lexsort((who, value))
        value, who = value[order], who[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (who[1:] != who[:-1])))
        value, who = value[new], who[new]
        group = np.cumsum(np.concatenate(([0], value[1:] != value[:-1])))
        keep = who[np.bincount(group)[group] > 1]
        found, counts = np.unique(keep, return_counts=True)
        return pd.DataFrame({"class": found, "shared": counts})

    return blobs.groupBy("bucket").applyInPandas(shared, "class long, shared long").groupBy("class").agg(F.sum("shared").alias("shared"))


SIGNATURE = [f"s{k}" for k in range(WORDS)]


def _signature(vector: str) -> list:
    """Columns of a parity signature: each shingle flips one of 64 * WORDS bits. Signatures of two sets differ in at most as many
    bits as there are shingles in just one of them."""
    flip = "aggregate({v}, 0L, (bits, x) -> if(((x.token >> 6) & {last}) = {k}, bits ^ shiftleft(1L, cast(x.token & 63 as int)), bits))"
    return [F.expr(flip.format(v=vector, last=WORDS - 1, k=k)).alias(f"s{k}") for k in range(WORDS)]


def jaccard_groups(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when den * |intersection| >= num * |union| of their sets of `width`-word shingles."""
    small_batches(documents.sparkSession)
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    members = materialize(_classes(docs, width, num, den), "members")
    small = F.col("n") > F.lit(0)
    classes = members.where(small).groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("class").alias("class"), F.first("need").alias("need"))
    total = members.agg(F.sum("n")).first()[0] or 0
    # a class with few shingles may miss all of its sample; it goes on as it is
    alive = classes.join(_shared(docs, width, num, den, total), "class", "left").where("need <= coalesce(shared, 0)")
    kept = materialize(alive.select("rep", "n"), "kept")
    labels = _labels(_postings(docs, kept, width, num, den), num, den)
    found = classes.select("key", "rep").join(labels, "rep", "left")
    # a key may be that of a third of all rows: the joined side has one row for it, and Spark splits the other
    full = members.join(found.select("key", F.coalesce("component", "rep").alias("component")), "key", "left")
    full = full.select("doc_id", F.col("n").alias("n_shingles"), F.when(small, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in text_slices(pdf, "text"):
                yield pd.DataFrame({"n_shingles": [len(v) for v in sets(some, width)]})

    nameless = documents.where("doc_id is null").select("text").mapInPandas(count, "n_shingles long")
    none = F.lit(None).cast("long")
    return full.unionByName(nameless.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def _postings(docs: DataFrame, kept: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Prefix postings of the classes in kept, and all their shared shingles by fragment of the global order."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in text_slices(pdf, "text"):
                yield pd.DataFrame({"rep": some["rep"].to_numpy(), "n": some["n"].to_numpy(), "tokens": [v.view(np.int64) for v in sets(some, width)]})

    tokens = materialize(docs.join(kept.hint("merge"), docs["doc_id"] == kept["rep"]).select("rep", "n", "text").dropDuplicates(["rep"]).mapInPandas(explode, "rep long, n long, tokens array<long>"), "tokens")
    flat = tokens.select("rep", "n", F.explode("tokens").alias("token"))
    df = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # the global order: rare first, ties by hash, in one long
    order = (F.shiftleft(F.least("df", F.lit(2**20)), 42) + F.shiftrightunsigned("token", 22)).alias("o")
    placed = flat.join(df, "token").select("rep", "n", "token", "df", order)
    vectors = materialize(
        placed.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("o", "token"))).alias("v"), F.avg(F.log("df")).alias("weight")).where(F.size("v") * den >= F.col("n") * num), "vectors"
    )  # a row holds one document's shingles, no more
    drop(tokens)
    cuts = vectors.select(F.explode("v.o").alias("o")).agg(F.percentile_approx("o", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000)).first()[0] or []
    slot = sum((F.when(F.col("x.o") > F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    segments = materialize(vectors.select("rep", F.explode("v").alias("x")).select("rep", slot.alias("fragment"), "x.token").groupBy("rep", "fragment").agg(F.collect_list("token").alias("tokens")), "segments")
    left = F.floor(F.col("n") * (den - num) / F.lit(den)) + 1 - (F.col("n") - F.size("v"))  # prefix, without the dropped shingles
    signed = vectors.withColumn("p", left).where("p > 0").select("rep", "n", F.size("v").alias("r"), "weight", F.slice("v", 1, F.col("p").cast("int")).alias("prefix"), *_signature("v"))
    postings = materialize(
        signed.select("rep", "n", "r", "weight", *SIGNATURE, F.posexplode("prefix").alias("at", "x"))
        .select("x.token", "rep", "n", "r", (F.col("r") - F.col("at")).alias("rest"), "weight", *SIGNATURE, F.col("rep").alias("component"), F.lit(1).cast("long").alias("size")), "postings"
    )
    drop(vectors)
    return postings, segments


def _differ(a: str, b: str):
    """Bits in which two signatures differ."""
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SIGNATURE), F.lit(0))


def _possible(a: str, b: str, num: int, den: int):
    """Whether two postings of one shingle, of different groups, may link.

    At the first shared shingle of two orders, the intersection is at most what is left of either, this one included. At a later
    shared shingle the bound is lower still, so a pair that may link passes at its first. The second bound: of both sets' r
    shingles together, those that differ, at least as many as differing bits, are in just one."""
    most = F.least(f"{a}.rest", f"{b}.rest", F.floor((F.col(f"{a}.r") + F.col(f"{b}.r") - _differ(a, b)) / 2))
    return den * most >= num * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def _ahead(posted: DataFrame, lists: DataFrame, turn: int) -> DataFrame:
    """Structs p and c of postings that follow each other in a list of shingles. Long lists are cut, by likeness as far as that goes."""
    near = F.shiftright(F.col(SIGNATURE[turn % WORDS]), 4 * (turn // WORDS) % 64).bitwiseAND(15).alias("near")
    cut = F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("k") / SPAN)).alias("cut")
    rows = posted.join(lists.select("token", "k"), "token").select("token", near, cut, F.struct("rep", "n", "r", "rest", *SIGNATURE, "component").alias("p"))
    by = Window.partitionBy("token", "near", "cut").orderBy(*(f"p.{SIGNATURE[(turn + k) % WORDS]}" for k in range(1, WORDS)), "p.rep")
    ahead = rows.select("p", *(F.lead("p", k).over(by).alias(f"c{k}") for k in range(1, AHEAD + 1)))
    return ahead.select("p", F.explode(F.array(*(f"c{k}" for k in range(1, AHEAD + 1)))).alias("c")).where("c is not null")


def _labels(parts: tuple[DataFrame, DataFrame], num: int, den: int) -> DataFrame:
    """rep, component of the classes that link with another: the least class that can be reached."""
    posted, segments = parts
    spark, held = posted.sparkSession, posted
    labels, all_links = spark.createDataFrame([], "rep long, component long"), []
    most, more, turn, made = posted.count(), True, 0, 0
    place = F.struct("size", "weight", F.negative("rep").alias("m"), "rep", "n", "r", "rest", *SIGNATURE, "component")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b, na, nb, ca, cb) that link: partial overlaps in each fragment, summed per pair."""
        # the fragment is part of both join keys: a class with many pairs is spread over them
        sa, sb = segments.select(F.col("rep").alias("a"), "fragment", F.col("tokens").alias("ta")), segments.select(F.col("rep").alias("b"), "fragment", F.col("tokens").alias("tb"))
        part = pairs.join(sa, "a").join(sb, ["b", "fragment"]).select(*pairs.columns, F.size(F.array_intersect("ta", "tb")).alias("k"))
        total = part.groupBy(*pairs.columns).agg(F.sum("k").alias("k"))
        return materialize(total.where(den * F.col("k") >= num * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b", "ca", "cb"), "links")

    while True:
        dealt = posted.repartition("token")
        groups = dealt.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"), F.max(place).alias("c"))
        # of each list with several groups: its head, and its pairs across groups
        lists = groups.groupBy("token").agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("groups"), F.sum("k").alias("k"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("cross"))
        lists = materialize(lists.where("groups > 1").select("token", "c", "k", "cross"), "lists")
        cross = lists.agg(F.sum("cross")).first()[0] or 0
        mixed = dealt.join(lists.select("token"), "token", "left_semi")
        if not more or cross <= most:
            break
        met = _ahead(posted, lists, turn) if turn else posted.alias("p").join(lists.select("token", "c.*").alias("c"), "token")
        met = met.where("p.component <> c.component").where(_possible("p", "c", num, den))
        near = met.select("p.rep", "p.n", "p.component", F.struct(_differ("p", "c").alias("d"), F.col("c.rep").alias("rep"), F.col("c.n").alias("n"), F.col("c.component").alias("component")).alias("c"))
        # what one class meets: no more than AHEAD times its shingles
        best = near.groupBy("rep", "n", "component").agg(F.explode(F.slice(F.sort_array(F.collect_set("c")), 1, BEST)).alias("c"))
        links = linked(best.select(F.col("rep").alias("a"), F.col("c.rep").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb"), F.col("component").alias("ca"), F.col("c.component").alias("cb")))
        done = links.count()
        made += done
        more = turn == 0 or FEW * done >= made > 0
        turn += 1
        if not done:
            continue
        all_links.append(links)
        labels = _merged(labels, links)
        grown = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        known = labels.join(grown, "component").select("rep", F.col("component").alias("to"), F.col("size").alias("grown"))
        kept = posted.join(lists.select("token"), "token", "left_semi").join(known, "rep", "left")
        posted = materialize(kept.withColumn("component", F.coalesce("to", "component")).withColumn("size", F.coalesce("grown", "size")).select(*held.columns), "postings")
        drop(held), drop(lists)
        held = posted
    # a pair comes out at the first shingle its prefixes share, once
    own = posted.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.negative("rest").alias("at"), "token"))).alias("prefix")).select("rep", F.col("prefix.token").alias("prefix"))
    mixed = mixed.join(own, "rep")
    pairs = mixed.alias("p").join(mixed.alias("c"), "token").where("p.component < c.component").where(_possible("p", "c", num, den)).where(F.array_intersect("p.prefix", "c.prefix")[0] == F.col("token"))
    sides = [F.col(f"{x}.{n}").alias(f"{m}{y}") for n, m in (("rep", ""), ("n", "n"), ("component", "c")) for x, y in (("p", "a"), ("c", "b"))]
    all_links.append(linked(pairs.select(*sides).distinct()))
    return components(reduce(DataFrame.unionByName, [x.select("a", "b") for x in all_links])).withColumnRenamed("id", "rep")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, component) after a step from links (a, b, ca, cb) between groups; the classes they name come in.

    Groups that links join through others may stay apart until a later round: they are tried again then, and all links are followed to their ends once, in the end."""
    to = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), STEPS)
    known = labels.unionByName(links.select(F.col("a").alias("rep"), F.col("ca").alias("component"))).unionByName(links.select(F.col("b").alias("rep"), F.col("cb").alias("component"))).distinct()
    return materialize(known.join(to.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("rep", F.coalesce("to", "component").alias("component")), "labels")
