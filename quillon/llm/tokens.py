"""Whole-text encoding with public BPE vocabularies, run once for each distinct chunk.

Texts are cut before spaces (Arrow kernels), chunks are dictionary-encoded, and the tokenizers library encodes each distinct
chunk that a worker doesn't know yet. Both vocabularies separate a space from what precedes it before any merge, so a text's
ids are its chunks' ids in order. The one exception, a space inside a longer run of white space, is recognised, and such
texts are given to the library whole."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbatch import release

_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"  # white space, for Arrow's patterns
_RUN = rf"[{_SPACE}] (?:[{_SPACE}]|\z)"
_MARKS = r"\x00"
WHOLE, FIRST = "\0whole\0", "\0first\0"  # before texts that are encoded as they are (as are all with a zero), and before first chunks

_SPACED = rf"\A [^{_SPACE}]+\z"
_WORD = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKED = _WORD + r"[.,;:!?#$%&*|]+\z"
Coded = tuple[list[str], np.ndarray, np.ndarray]  # chunks in some order, their ids, the number of ids of each


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def in_turn(chunks: list[str], coded: list[list[int]]) -> Coded:
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    return chunks, np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths


class Library:
    """Chunks through the tokenizers library: most of them joined to one text, whose ids are then cut at the chunks' ends."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.tokenizer.encode_special_tokens = True
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # 'byte': bytes of each id, a character of its name for each; 'word': whether the id ends a word
        self.of_id = np.array([len(x) if kind == "byte" else x.endswith("</w>") for x in names], np.int64)

    def __call__(self, chunks: list[str]) -> Coded:
        text = pa.array(chunks, pa.large_string())
        if self.kind == "byte":
            size = np.where(_matches(text, _SPACED), pc.binary_length(text).to_numpy(), 0)
        else:  # words: a run of letters is one, a run of marks after it another
            size = np.where(_matches(text, _WORD + r"\z"), 1, 2 * _matches(text, _MARKED))
        joined, single = list(compress(chunks, size > 0)), list(compress(chunks, size == 0))
        ids = np.array(self.tokenizer.encode_batch_fast([("" if self.kind == "byte" else " ").join(joined)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.of_id[ids]), np.cumsum(size[size > 0])) + 1
        order, rest, lengths = in_turn(single, [e.ids for e in self.tokenizer.encode_batch_fast([c.removeprefix(WHOLE) for c in single], add_special_tokens=False)])
        return joined + order, np.concatenate((ids, rest)), np.concatenate((np.diff(ends, prepend=0), lengths)).astype(np.int64)


class ChunkEncoder:
    """encode_chunks: ids of chunks, and of texts after WHOLE. lead, first: what stands before a later and the first chunk in
    place of its space. odd: an Arrow pattern of texts that must not be cut. index: chunks without lead, first chunks after FIRST."""

    MOST = 500_000  # chunks that a worker remembers; later ones are encoded for their batch alone

    def __init__(self, encode_chunks: Callable[[list[str]], Coded], lead: str, first: str, odd: str):
        self.encode_chunks, self.lead, self.first, self.odd = encode_chunks, lead, first, odd
        self.index: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    @classmethod
    @cache
    def get(cls, path: str, kind: str) -> ChunkEncoder:
        """kind: 'byte' (a space belongs to the following chunk) or 'word' (white space is dropped)."""
        if kind == "word":
            encoder = cls(Library(path, kind), "", "", _MARKS)
            encoder.MOST = 1_000_000
            return encoder
        encoder = cls(Library(path, kind), " ", "", f"{_RUN}|{_MARKS}")
        encoder.MOST = 1_200_000
        return encoder

    def _learn(self, named: dict[str, str]) -> None:
        """named: the chunk of each text to encode."""
        texts, coded, lengths = self.encode_chunks(list(named))
        chunks = [named[t] for t in texts]
        k, n = len(self.index), int(self.ends[len(self.index)])
        while k + len(chunks) + 1 > len(self.ends):
            self.ends = np.resize(self.ends, 2 * len(self.ends))
        while n + len(coded) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[n : n + len(coded)] = coded
        self.ends[k + 1 : k + 1 + len(chunks)] = n + np.cumsum(lengths)
        self.index.update(zip(chunks, range(k, k + len(chunks)), strict=True))

    def _rows(self, chunks: list[str], lead: str, skip: int = 0) -> np.ndarray:
        """Places of chunks in the index; new ones are encoded with lead in place of their first `skip` characters."""
        at = list(map(self.index.get, chunks))
        if None in at:
            new = [k for k, x in enumerate(at) if x is None]
            self._learn({lead + chunks[k][skip:]: chunks[k] for k in new})
            for k in new:
                at[k] = self.index[chunks[k]]
        return np.array(at, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids). Null is empty."""
        kept = len(self.index)
        texts = [t or "" for t in texts]
        column = pa.array(texts, pa.large_string())
        whole = [(k, texts[k]) for k in np.flatnonzero(_matches(column, self.odd)).tolist()]
        if whole:
            for k, _ in whole:
                texts[k] = ""
            column = pa.array(texts, pa.large_string())
        parts = pc.split_pattern(column, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.dictionary_encode() if len(parts.values) else pa.array([""], pa.large_string()).dictionary_encode()
        at = self._rows(coded.dictionary.to_pylist(), self.lead)[coded.indices.to_numpy()][: offsets[-1]]
        if self.first != self.lead and len(texts):
            at[offsets[:-1]] = self._rows([FIRST + t.partition(" ")[0] for t in texts], self.first, len(FIRST))
        for k, t in whole:
            at[offsets[k]] = self._rows([WHOLE + t], "")[0]
        lengths = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.ends[at] - ends[:-1], lengths)]
        if len(self.index) > self.MOST:
            for x in list(self.index)[max(kept, self.MOST) :]:
                del self.index[x]
        return ids, ends[offsets]


def forget() -> None:
    """Drop what a worker's encoders remember: workers live on, and other steps need the memory."""
    ChunkEncoder.get.cache_clear()
    release()
