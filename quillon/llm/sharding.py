"""Histogram sort: exact byte counts below probed key boundaries, refined until the splitters meet a tolerance; one exchange.

Rows are ordered by (group key, row key): the 63-bit hash of a row's group, then an integer id. A splitter falls between two
groups wherever the tolerance allows, so equal texts share a shard unless one group outweighs the tolerance; such a group is
cut by the id, here a number that each row gets when the narrow table is written, so repeated rows are cut too. Each round is one aggregation with map-side sums over a narrow table; the driver sees at most a few thousand
counts, whatever the input's size. Null group keys form one group; null ids count as the least id."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

FAN = 4096
TOP = 2**63 - 1


def _counts(df: DataFrame, key: Column, brackets: Sequence[tuple[int, int]], weight: str, fan: int) -> list[dict[int, int]]:
    """For each half-open key range, the weight in each of `fan` equal parts."""
    bucket, spans = F.lit(None).cast("long"), []
    for i, (lo, hi) in enumerate(brackets):
        step = max(1, -(-(hi - lo) // fan))
        spans.append(step)
        inside = (key >= F.lit(lo)) & (key < F.lit(hi) if hi <= TOP else F.lit(True))
        bucket = F.when(inside, F.call_function("div", key - F.lit(lo), F.lit(step)) + F.lit(i * fan)).otherwise(bucket)
    rows = df.select(bucket.alias("bucket"), F.col(weight).cast("long").alias("w")).where("bucket is not null").groupBy("bucket").agg(F.sum("w").alias("w")).collect()
    out: list[dict[int, int]] = [{} for _ in brackets]
    for r in rows:
        out[r["bucket"] // fan][r["bucket"] % fan] = r["w"]
    return out


def _refine(df: DataFrame, key: Column, start: tuple[int, int], targets: list[tuple[int, int]], weight: str, tolerance: float) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """targets: (name, weight wanted below). Returns boundaries by name, and for those that fall inside one key value (value, weight still wanted in it)."""
    state = {name: (*start, 0) for name, _ in targets}
    want, done, inside = dict(targets), {}, {}
    while state:
        brackets = sorted({s[:2] for s in state.values()})
        brackets = brackets[:64]  # the rest follow in the next rounds: a plan of bounded width
        fan = max(16, FAN // len(brackets))
        found = dict(zip(brackets, _counts(df, key, brackets, weight, fan)))
        for name, (lo, hi, below) in list(state.items()):
            if (lo, hi) not in found:
                continue
            step, at, goal = max(1, -(-(hi - lo) // fan)), below, want[name]
            for part, w in sorted(found[lo, hi].items()):
                a, b = lo + part * step, min(hi, lo + (part + 1) * step)
                if at + w >= goal or b >= hi:
                    if goal - at <= tolerance:
                        done[name] = a
                    elif abs(at + w - goal) <= tolerance:
                        done[name] = b
                    elif b - a == 1:
                        inside[name] = (a, goal - at)
                    else:
                        state[name] = (a, b, at)
                        break
                    del state[name]
                    break
                at += w
            else:
                done[name] = hi
                del state[name]
    return done, inside


def splitters(df: DataFrame, group: str, row: str, weight: str, fractions: Sequence[float], tolerance: float) -> list[tuple[int, int | None]]:
    """Boundaries (group value, row value or None) below which lie the given fractions of the weight, each within tolerance x the mean share."""
    total = df.agg(F.sum(F.col(weight).cast("long"))).first()[0] or 0
    slack = tolerance * total / (len(fractions) + 1)
    if not total:
        return []
    done, inside = _refine(df, F.col(group), (0, TOP), [(i, round(f * total)) for i, f in enumerate(fractions)], weight, slack)
    out: dict[int, tuple[int, int | None]] = {i: (v, None) for i, v in done.items()}
    for value in {v for v, _ in inside.values()}:
        mine = df.where(F.col(group) == F.lit(value))
        lo, hi = mine.agg(F.min(row), F.max(row)).first()
        ends, cut = _refine(mine, F.col(row), (lo, hi + 1), [(i, w) for i, (v, w) in inside.items() if v == value], weight, slack)
        out |= {i: (value, v) for i, v in ends.items()} | {i: (value, v + 1) for i, (v, _) in cut.items()}
    return sorted(out.values(), key=lambda x: (x[0], -(2**63) if x[1] is None else x[1]))


def _with_part(df: DataFrame, group: str, row: str, bounds: list[tuple[int, int | None]]) -> DataFrame:
    """Add _part: how many bounds are at or below (group, row). Each of the 2**12 equal ranges of the group key has its own few."""
    rows = [[] for _ in range(1 << 12)]
    for g, r in bounds:
        rows[min(g >> 51, (1 << 12) - 1)].append((g, -(2**63) if r is None else r))
    table, below = [], 0
    for k, own in enumerate(rows):
        table.append((k, below, own))
        below += len(own)
    ranges = df.sparkSession.createDataFrame(table, "_range long, _below int, _bounds array<struct<g: long, r: long>>")  # a row for each range
    under = F.filter("_bounds", lambda b: (b["g"] < F.col(group)) | ((b["g"] == F.col(group)) & (b["r"] <= F.col(row))))
    marked = df.withColumn("_range", F.shiftright(group, 51)).join(F.broadcast(ranges), "_range")
    return marked.withColumn("_part", F.col("_below") + F.size(under)).drop("_range", "_below", "_bounds")


def histogram_shards(df: DataFrame, shards: int, group: str, row: str, size: str, tolerance: float = 0.002, parts: int | None = None) -> DataFrame:
    """Add `shard` (near-equal sums of `size`) and `slot` (gapless from 0 in each shard, in key order).

    Columns `group` and `row` are integers of at least 0 and any integer. The table is read once for each round; pass a narrow one."""
    spark = df.sparkSession
    parts = parts or min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_size = splitters(df, group, row, size, [k / shards for k in range(1, shards)], tolerance)
    ones = df.withColumn("_one", F.lit(1))
    by_rows = splitters(ones, group, row, "_one", [k / parts for k in range(1, parts)], 0.25)
    least = lambda b: (b[0], -(2**63) if b[1] is None else b[1])
    bounds = sorted({*by_size, *by_rows}, key=least)
    shard_of = np.searchsorted([i for i, b in enumerate(bounds) if b in set(by_size)], range(len(bounds) + 1), "left") if by_size else np.zeros(len(bounds) + 1, int)
    marked = _with_part(df, group, row, bounds)
    counts, base, rows = {r["_part"]: r["count"] for r in marked.groupBy("_part").count().collect()}, {}, []
    for p, s in enumerate(shard_of):
        rows.append((p, int(s), base.get(s, 0)))
        base[s] = base.get(s, 0) + counts.get(p, 0)
    table = spark.createDataFrame(rows, "_part int, shard int, _base long")  # a row for each part: at most `parts` + `shards`
    place = F.row_number().over(Window.partitionBy("_part").orderBy(group, row))
    return marked.withColumn("_place", place).join(F.broadcast(table), "_part").withColumn("slot", F.col("_base") + F.col("_place") - 1).drop("_part", "_place", "_base")


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; null text: no bytes, size 1. Law: bytes."""
    text = F.col("text")
    narrow = materialize(
        documents.select(
            "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("_group"), F.monotonically_increasing_id().alias("_row"),
        ), "shard-keys")
    out = histogram_shards(narrow, shards, "_group", "_row", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
