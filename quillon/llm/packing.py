"""Sum-of-squares packing of token pieces into sequences of a fixed capacity.

A piece goes where the sum over residual gaps g of (open sequences with gap g)^2 becomes smallest, a new sequence included;
ties prefer the smaller gap. A row without doc_id is packed like any other. Pieces are dealt by hash into groups of about GROUP rows, each packed in one task, so no task
grows with the input; a group loses at most its few last open sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, named, nameless, small_batches
from .textbatch import text_slices
from .tokens import ChunkEncoder

GROUP = 32_768


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length (1 to capacity), longest first."""
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        gaps = open_[s:capacity]
        if s == capacity or not gaps.any():
            best = capacity
        else:
            change = 2 * (open_[: capacity - s] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]  # closing a sequence adds no gap
            change[gaps == 0] = 4 * len(lengths) + 4
            j = int(change.argmin())
            best = s + j if change[j] <= 2 * open_[capacity - s] + 1 else capacity
        if best == capacity:
            at, made = made, made + 1
        else:
            at = stacks[best].pop()
            open_[best] -= 1
        where[k], offset[k] = at, capacity - best
        if best > s:
            stacks[best - s].append(at)
            open_[best - s] += 1
    return where, offset


def token_pieces(docs: DataFrame, tokenizer: str, kind: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, nameless, piece, start, length, ids_crc32: each document's ids with the end id, cut only where longer than capacity. Null text: empty."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder.get(tokenizer, kind)
        for pdf in batches:
            for some in text_slices(pdf, "text"):
                ids, offsets = encoder.encode(some["text"].tolist())
                rows = []
                for k, doc in enumerate(zip(some["doc_id"].tolist(), some["nameless"].tolist())):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(*doc, i, at, len(x := own[at : at + capacity]), zlib.crc32(x.tobytes())) for i, at in enumerate(range(0, len(own), capacity))]
                yield pd.DataFrame(rows, columns=["doc_id", "nameless", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return nameless(docs).mapInPandas(cut, "doc_id long, nameless boolean, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length (1 to capacity)."""
    groups = max(1, round(pieces.count() / group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["_group"].to_numpy(np.int64) << 40) + where, offset=offset).drop(columns="_group")

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))).groupBy("_group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", capacity: int = 2048) -> DataFrame:
    return named(pack(materialize(token_pieces(docs, tokenizer, kind, capacity), "pieces"), capacity))
