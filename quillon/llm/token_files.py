"""Token-id files: independent zstandard frames, a trailing seek table and per-frame checksums.

A file is: frames | document table (a skippable frame) | seek table (a skippable frame that readers find from the end).
Each frame holds the ids of whole documents, little-endian unsigned 32-bit. The seek table has, for each frame, compressed
size, plain size and the low 32 bits of the XXH64 of the plain bytes. Files are rows of a Parquet table (part, seq, image),
so any Hadoop store takes them and Spark's commit protocol covers lost and repeated tasks; doc_ids is a column of its own, so a
search for documents reads no image but of the files that hold them, and decompresses no frame but theirs. Null texts are empty
documents; rows without doc_id come first, as in Spark's ascending order. A very long document is one frame."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import rank_encoder
from .storage import materialize, named, nameless, small_batches
from .textbatch import text_slices
from .tokens import ChunkEncoder

SKIPPABLE, SEEK_END = 0x184D2A5E, 0x8F92EAB1
FRAME_IDS, FILE_IDS = 16_384, 1_000_000


def pack_file(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """docs: (doc_id, ids). A frame closes after FRAME_IDS ids. A document's row in the table: doc_id, frame, start there, ids, whether doc_id is null."""
    packer, frames, table, held, n = zstandard.ZstdCompressor(level=1), [], [], [], 0

    def close() -> None:
        plain = np.concatenate(held).astype("<u4").tobytes() if held else b""
        frames.append((packer.compress(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        held.clear()

    for doc, ids in docs:
        table.append((doc or 0, len(frames), n, len(ids), doc is None))
        held.append(ids)
        n += len(ids)
        if n >= FRAME_IDS:
            close()
            n = 0
    if held:
        close()
    index = np.array(table, "<i8").reshape(-1, 5).tobytes()
    seek = b"".join(struct.pack("<III", len(c), size, check) for c, size, check in frames) + struct.pack("<IBI", len(frames), 0x80, SEEK_END)
    return b"".join([*(c for c, _, _ in frames), struct.pack("<II", SKIPPABLE, len(index)), index, struct.pack("<II", SKIPPABLE, len(seek)), seek])


class TokenFile:
    """Reader of one file image; decompresses only the frames that are asked for."""

    def __init__(self, image: bytes):
        count, flag, magic = struct.unpack("<IBI", image[-9:])
        if magic != SEEK_END or flag != 0x80:
            raise ValueError("no seek table")
        size = 12 * count + 9
        entries = np.frombuffer(image, "<u4", 3 * count, len(image) - size).reshape(-1, 3)
        self.image, self.entries, self.at = image, entries, np.concatenate(([0], np.cumsum(entries[:, 0], dtype=np.int64)))
        start = int(self.at[-1])
        self.docs = np.frombuffer(image, "<i8", struct.unpack("<II", image[start : start + 8])[1] // 8, start + 8).reshape(-1, 5)
        self.cache: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def frame(self, k: int) -> np.ndarray:
        if self.cache[0] != k:
            plain = zstandard.ZstdDecompressor().decompress(self.image[self.at[k] : self.at[k + 1]], max_output_size=max(1, int(self.entries[k, 1])))
            if len(plain) != self.entries[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[k, 2]:
                raise ValueError(f"frame {k}: wrong checksum")
            self.cache = (k, np.frombuffer(plain, "<u4"))
        return self.cache[1]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the row-th document of the file."""
        _, k, start, n, _ = self.docs[row]
        return self.frame(int(k))[start : start + n]


def write_token_files(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, partitions: int | None = None, ranks: str | None = None) -> DataFrame:
    """ranks: the same vocabulary's ranks, if they are at hand, for speed. Encode doc_id, text in ascending doc_id order (ties by text) and store the files. Rows: part, seq, start (ids before the file in its part), n_ids, doc_ids, image."""
    small_batches(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = rank_encoder(tokenizer, ranks) if ranks else ChunkEncoder.get(tokenizer, kind), TaskContext.get().partitionId()
        held, total, start, seq = [], 0, 0, 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "start": [start], "n_ids": [total], "doc_ids": [[d for d, _ in held]], "image": [pack_file(held)]})

        for pdf in batches:
            for some in text_slices(pdf, "text"):
                ids, offsets = encoder.encode(some["text"].tolist())
                for k, (doc, none) in enumerate(zip(some["doc_id"].tolist(), some["nameless"].tolist())):
                    held.append((None if none else doc, np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id))))
                    total += len(held[-1][1])
                    if total >= FILE_IDS:
                        yield row()
                        start, seq, total = start + total, seq + 1, 0
                        held.clear()
        if held:
            yield row()

    order = (F.desc("nameless"), F.asc("doc_id"))
    ordered = nameless(docs).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return materialize(ordered.mapInPandas(write, "part int, seq int, start long, n_ids long, doc_ids array<long>, image binary"), "token-files", "uncompressed")


def read_documents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in wanted. Frames without any of them stay compressed; rows of one doc_id are all returned."""
    at = files.select("part", "seq", F.posexplode("doc_ids").alias("row", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id")
    rows = at.groupBy("part", "seq").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # of one file

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, some in zip(pdf["image"], pdf["rows"]):
                file = TokenFile(bytes(image))
                yield pd.DataFrame({"doc_id": file.docs[some, 0], "ids": [file.ids(k).astype(np.int64) for k in some]})

    return files.join(rows, ["part", "seq"]).select("image", "rows").mapInPandas(read, "doc_id long, ids array<long>")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document of the files."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part, not for each document
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, start in zip(pdf["image"], pdf["start"] + pdf["before"]):
                file = TokenFile(bytes(image))
                n = file.docs[:, 3]
                yield pd.DataFrame({"doc_id": file.docs[:, 0], "nameless": file.docs[:, 4] > 0, "start": start + np.concatenate(([0], np.cumsum(n)[:-1])), "n_tokens": n, "ids_crc32": [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(len(n))]})

    small_batches(files.sparkSession)
    return named(files.join(F.broadcast(before), "part").select("start", "before", "image").mapInPandas(read, "doc_id long, nameless boolean, start long, n_tokens long, ids_crc32 long"))
