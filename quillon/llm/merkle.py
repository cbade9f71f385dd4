"""A Merkle manifest of documents by supersteps over RDDs of vertices, and the proof of every leaf against its root.

A vertex is (group, index): a group's leaves are its documents in ascending doc_id order, and vertex i of a level is the parent
of vertices WIDTH * i and following of the level below. In a superstep upward every active vertex sends its digest to its
parent; a parent that has all its messages keeps them, hashes them and is active in the next. A group's only vertex of a level
halts as its subroot. Subroots, in order of their sources, are the leaves of one more group, whose last vertex is the root. In the supersteps downward
each parent sends the digests of its children and what it got itself to all of them, so that in the end each run of leaves
holds the sibling path of its leaves, which fold it into proofs. A vertex receives WIDTH digests upward and one path
downward, WIDTH digests for each level, so no message box grows with the input, whatever a source's share of it.

Groups are numbered by the place of their first leaf, which keeps the order of their sources. Leaves are hashed in one pass over the
texts; every later step moves digests. Each superstep's vertices are a table in the shared folder, so a lost executor repeats one
superstep at most. The driver sees a row for each range of the sort and the number of levels.

Null columns, doc_id and text among them, are hashed as '-'; a null doc_id comes first in its source, a null source first of
all, and null is not the empty string. Rows with one doc_id are ordered by their leaves, repeated rows anyhow, for they are
equal. A source of one document has its leaf as subroot, a manifest of one source its subroot as root. An empty table has no
rows. Columns beyond the five are ignored."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Vertex = tuple[int, int]  # group, index
Box = tuple[tuple[bytes, ...], int]  # the children's digests in order; at a group's first vertex also the size of their level
Path = tuple[tuple[int, tuple[bytes, ...]], ...]  # (place in a run, the run's digests), from below to the root
Word = tuple[bytes, Path]  # subroot, path


def digest(parts: Iterable[bytes]) -> bytes:
    """SHA-256 of the digests' lowercase hex texts."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 (binary) of the fields: '-' where null, else byte count, ':', value."""
    coded = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.unhex(F.sha2(F.concat(*coded), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """row, source, doc_id, leaf, tampered (the leaf with its text's A-Z lower-cased, where crc32 of the decimal doc_id is a multiple of 5)."""
    here = {name: F.col(name) for name in FIELDS}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(F.monotonically_increasing_id().alias("row"), "source", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(here).alias("leaf"), F.when(chosen, leaf_digest(here | {"text": lower})).alias("tampered"))


def numbered(leaves: DataFrame) -> DataFrame:
    """Add grp (the number of leaves before those of the row's source) and idx (place in the source) by one range sort."""
    spark = leaves.sparkSession
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, run, last = TaskContext.get().partitionId(), 0, 0, None
        for pdf in batches:
            runs = []
            for source in pdf["source"].astype(object).where(pdf["source"].notna(), None):
                if seen and source != last:
                    run = seen
                runs.append(run)
                seen, last = seen + 1, source
            yield pdf.assign(part=part, place=range(seen - len(pdf), seen), run=runs)

    schema = "row long, source string, doc_id long, leaf binary, tampered binary, part int, place long, run long"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = leaves.withColumn("nameless", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    back = [*order[:1], F.desc("nameless"), *order[1:]]
    put = kept.repartitionByRange(count, *back).sortWithinPartitions(*back).mapInPandas(place, schema + ", nameless boolean")
    table = materialize(put, "leaf-order")
    ends = table.groupBy("part").agg(F.max("place").alias("n"), F.max("run").alias("run"), F.min_by(F.struct("source"), "place").alias("a"), F.max_by(F.struct("source"), "place").alias("z")).orderBy("part").collect()  # a row for each range
    rows, base, start, last = [], 0, 0, None
    for r in ends:
        start = start if last is not None and r["a"] == last else base
        rows.append((r["part"], base, start))
        start, last = (base + r["run"] if r["run"] else start), r["z"]
        base += r["n"] + 1
    bases = spark.createDataFrame(rows, "part int, base long, carried long")
    at = table.join(F.broadcast(bases), "part").withColumn("grp", F.when(F.col("run") > 0, F.col("base") + F.col("run")).otherwise(F.col("carried")))
    return at.select("grp", (F.col("base") + F.col("place") - F.col("grp")).alias("idx"), F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "leaf", "tampered")


def _received(messages: RDD, parts: int) -> RDD:
    """(vertex, box) of all that got messages: (vertex, (place, digest)) from children, (vertex, (-1, size)) from a group's first child."""

    def box(got: Iterable[tuple[int, bytes | int]]) -> Box:
        ordered = sorted(got, key=lambda m: m[0])
        return tuple(d for k, d in ordered if k >= 0), next((n for k, n in ordered if k < 0), 0)

    return messages.groupByKey(parts).mapValues(box)


def _kept(vertices: RDD, name: str) -> DataFrame:
    spark = SparkSession.active()
    rows = vertices.map(lambda v: (*v[0], v[1][1], list(v[1][0])))
    return materialize(spark.createDataFrame(rows, "grp long, idx long, size long, children array<binary>", verifySchema=False), name)


def _vertices(table: DataFrame) -> RDD:
    return table.rdd.map(lambda r: ((r[0], r[1]), (tuple(map(bytes, r[3])), r[2])))


def _halts(vertex: tuple[Vertex, Box]) -> bool:
    """Whether a vertex stands above its group's only vertex, which then is the subroot."""
    (_, i), (_, size) = vertex
    return i == 0 and size == 1


def _up(vertex: tuple[Vertex, Box]) -> list:
    """The messages of an active vertex to its parent; a group's first vertex also tells the size of its own level."""
    (g, i), (children, size) = vertex
    return [((g, i // WIDTH), (i % WIDTH, digest(children)))] + ([((g, 0), (-1, -(-size // WIDTH)))] if i == 0 else [])


def climb(messages: RDD, most: int, parts: int, name: str) -> tuple[list[DataFrame], RDD]:
    """Supersteps upward from the messages of the leaves; most: the leaves of the largest group.

    Returns the vertices of each level, from the leaves' parents on, and (group, subroot)."""
    levels, roots = [], messages.context.emptyRDD()
    while True:
        levels.append(_kept(_received(messages, parts), f"{name}-{len(levels)}"))
        here = _vertices(levels[-1])
        roots = roots.union(here.filter(_halts).map(lambda v: (v[0][0], v[1][0][0])))
        if most <= 1:
            return levels, roots
        messages, most = here.filter(lambda v: not _halts(v)).flatMap(_up), -(-most // WIDTH)


def _down(told: tuple[Vertex, tuple[Box, Word]]) -> list:
    """What a vertex sends to its children: their run on top of the path; above a subroot, the path alone."""
    (g, i), ((children, size), (subroot, path)) = told
    if _halts((told[0], (children, size))):
        return [((g, 0), (subroot, path))]
    return [((g, i * WIDTH + k), (subroot, ((k, children), *path))) for k in range(len(children))]


def descend(levels: list[DataFrame], words: RDD, parts: int) -> RDD:
    """Supersteps downward. words: (group, (subroot, path above it)). Returns the words that reach the leaves' parents, with their boxes: (vertex, (box, word))."""
    start, sent = words.map(lambda w: ((w[0], 0), w[1])), words.context.emptyRDD()
    for table in reversed(levels):
        here = _vertices(table)
        told = here.filter(_halts).join(start, parts).union(here.filter(lambda v: not _halts(v)).join(sent, parts))
        sent = told.flatMap(_down)
    return told


def around(path: Path) -> list[tuple[bytes, bytes]]:
    """The hex digests before and behind a node, level by level."""
    text = lambda run: b"".join(d.hex().encode() for d in run)
    return [(text(run[:k]), text(run[k + 1 :])) for k, run in path]


def fold(leaf: bytes, sides: list[tuple[bytes, bytes]]) -> str:
    """The root (hex) that a leaf and its siblings lead to."""
    here = leaf.hex().encode()
    for before, behind in sides:
        here = hashlib.sha256(before + here + behind).hexdigest().encode()
    return here.decode()


def prove(box: Box, word: Word, leaves: Iterable[tuple[int, int | None, bytes | None]], root: str) -> Iterator[tuple]:
    """The rows of a run of leaves: (place, doc_id, tampered leaf or None)."""
    (children, size), (subroot, path) = box, word
    upper = around(path)
    proof = b"".join(x for side in upper for x in side)
    for k, doc, tampered in leaves:
        own = [] if size == 1 else around(((k, children),))
        folded = fold(tampered or children[k], own + upper)
        yield doc, children[k].hex(), subroot.hex(), root, hashlib.sha256(b"".join(x for side in own for x in side) + proof).hexdigest(), folded, folded == root


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    leaves = materialize(document_leaves(docs), "leaves")
    ordered = materialize(numbered(leaves), "leaves-numbered")
    sizes = ordered.groupBy("grp").count()
    most = sizes.agg(F.max("count")).first()[0]
    if not most:
        return spark.createDataFrame([], schema)
    sent = ordered.select("grp", "idx", "leaf").rdd.map(lambda r: ((r[0], r[1] // WIDTH), (r[1] % WIDTH, bytes(r[2]))))
    levels, subroots = climb(sent.union(sizes.rdd.map(lambda r: ((r[0], 0), (-1, r[1])))), most, parts, "vertices")
    ranked = subroots.sortByKey(numPartitions=parts).zipWithIndex().map(lambda x: (*x[0], x[1]))
    named = materialize(spark.createDataFrame(ranked, "grp long, digest binary, idx long", verifySchema=False), "subroots")
    sources, top = named.count(), -1
    sent = named.rdd.map(lambda r: ((top, r[2] // WIDTH), (r[2] % WIDTH, bytes(r[1]))))
    top_levels, roots = climb(sent.union(spark.sparkContext.parallelize([((top, 0), (-1, sources))], 1)), sources, parts, "top-vertices")
    root = roots.values().first()
    above = descend(top_levels, spark.sparkContext.parallelize([(top, (root, ()))], 1), parts).flatMap(_down)  # (the subroot's place, (root, path))
    words = above.map(lambda m: (m[0][1], m[1][1])).join(named.rdd.map(lambda r: (r[2], (r[0], bytes(r[1])))), parts).map(lambda x: (x[1][1][0], (x[1][1][1], x[1][0])))
    own = ordered.select("grp", "idx", "doc_id", "tampered").rdd.map(lambda r: ((r[0], r[1] // WIDTH), (r[1] % WIDTH, r[2], r[3] and bytes(r[3]))))
    runs = descend(levels, words, parts).cogroup(own, parts).flatMap(lambda v: (x for box, word in v[1][0] for x in prove(box, word, v[1][1], root.hex())))
    return spark.createDataFrame(runs, schema, verifySchema=False)
