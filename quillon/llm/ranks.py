"""The byte-level chunk encoder with a faster library for plain chunks.

A chunk of a space and Latin letters, digits and marks is encoded from the vocabulary's ranks, which give the ids that the
tokenizers library gives; all others go to that library."""

from __future__ import annotations

import base64
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import _MARKS, _RUN, ChunkEncoder, Coded, Library, _matches

_PLAIN = r"\A [\x21-\x7E\x{C0}-\x{24F}]+\z"
#: Fixed value: how the vocabulary's texts are cut before merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankLibrary(Library):
    def __init__(self, path: str, ranks: str):
        super().__init__(path, "byte")
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, chunks: list[str]) -> Coded:
        text = pa.array(chunks, pa.large_string())
        plain = _matches(text, _PLAIN)
        size = pc.binary_length(text).to_numpy()[plain]
        joined, rest = list(compress(chunks, plain)), list(compress(chunks, ~plain))
        ids = np.asarray(self.fast.encode_to_numpy("".join(joined)), np.uint32)
        ends = np.searchsorted(np.cumsum(self.of_id[ids]), np.cumsum(size)) + 1
        names, more, lengths = super().__call__(rest)
        return joined + names, np.concatenate((ids, more)), np.concatenate((np.diff(ends, prepend=0), lengths)).astype(np.int64)


@cache
def rank_encoder(path: str, ranks: str) -> ChunkEncoder:
    encoder = ChunkEncoder(RankLibrary(path, ranks), " ", "", f"{_RUN}|{_MARKS}")
    encoder.MOST = 1_200_000
    return encoder
