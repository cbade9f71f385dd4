"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut wherever two characters meet that stand side by side in no piece: no piece crosses such a place, so the parts are
encoded apart. The distinct parts of a batch that a worker doesn't know yet are concatenated and indexed by a suffix array, in
slices of about SLICE characters. Every piece of the vocabulary is binary-searched for its range of occurrences; these
are edges between text positions. Sorted by end position they are relaxed from left to right, in all parts at once: a
position's label is the last piece of the encoding of the text before it, and an edge may extend a label when the two pieces stay
apart under the model's merge order. For a BPE model that label is unique, so the path to the last position is the model's own
encoding. Characters outside the vocabulary become byte pieces. Null texts are empty; a row without doc_id keeps none. Texts hold
no mark of their own: a literal mark encodes like a space, as in the library. A text's memory is its own size's, whatever it is."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .storage import materialize, named, nameless, small_batches
from .textbatch import text_slices

MARK = "▁"
SLICE = 400_000  # characters that are indexed at once


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` codes or more (prefix doubling)."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < depth:
        ahead = np.concatenate((rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)))[: len(rank)]
        key = rank * (len(rank) + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty_like(rank)
        rank[order] = new
        if not len(new) or new[-1] == len(rank) - 1:
            break
        step *= 2
    return order


class SuffixEncoder:
    """Pieces are numbered by rank here: single characters first, then in the order in which the model merges them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)  # only its vocabulary is used
        n = range(model.get_piece_size())
        plain = [i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = [model.id_to_piece(i) for i in n]
        self.byte = {int(self.text[i][3:5], 16): i for i in n if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.high_bytes = np.array([i for i, b in self.byte_of.items() if b > 127], np.int32)
        plain.sort(key=lambda i: (len(self.text[i]) > 1, -model.get_score(i), i))
        self.id = np.array(plain, np.int32)
        pieces = [self.text[i] for i in plain]
        self.rank = {p: k for k, p in enumerate(pieces)}
        self.lengths = np.array([len(p) for p in pieces])
        self.depth = int(self.lengths.max())
        # merges: which two pieces join to which; and the last merge of each piece's own encoding, itself for single characters
        pairs = sorted((self.rank[a] * len(pieces) + self.rank[b], k) for k, p in enumerate(pieces) for j in range(1, len(p)) if (a := p[:j]) in self.rank and (b := p[j:]) in self.rank)
        self.pairs, self.joined = np.array([x for x, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int32)
        self.left, self.right = np.arange(len(pieces)), np.arange(len(pieces))
        whole = np.ones(len(pieces), bool)
        for k, p in enumerate(pieces):
            if len(p) > 1:
                last = self._last_merge(p)
                whole[k] = last is not None
                self.left[k], self.right[k] = last or (k, k)
        by = sorted(np.flatnonzero(whole).tolist(), key=pieces.__getitem__)
        self.sorted = np.array(by)  # in the order of their code points
        self.low, self.high = (np.array([pieces[k] + x for k in by], f"<U{self.depth + 1}") for x in ("", "\U0010ffff"))
        self.plain = pa.array([chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else t.replace(MARK, " ") for i, t in enumerate(self.text)])
        # characters that stand beside others in pieces, by code point (0: any other), and which of them meet there
        inner = sorted({p[k : k + 2] for p in pieces for k in range(len(p) - 1)})
        beside = sorted({ord(c) for x in inner for c in x})
        kind = {c: k for k, c in enumerate(beside, 1)}
        self.kind = np.zeros(max(beside, default=0) + 2, np.int32)
        self.kind[beside] = np.arange(1, len(beside) + 1)
        self.meet = np.zeros((len(beside) + 1, len(beside) + 1), bool)
        for x, y in inner:
            self.meet[kind[ord(x)], kind[ord(y)]] = True

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces that the model joins last in a piece's text; None where it doesn't end as this piece."""
        parts, last = list(text), None
        while len(parts) > 1:
            found = [(self.rank.get(x + y, len(self.rank)), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))]
            best, at = min(found)
            if best == len(self.rank):
                return None
            last = self.rank.get(parts[at]), self.rank.get(parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return last if last and None not in last else None

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of two pieces' joined text is the two pieces: undo their merges, latest first; none of the pairs
        that meet at the border on the way may have joined before."""
        out = np.ones(len(a), bool)
        at, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), len(self.id))
        while len(at):
            key = a * len(self.id) + b
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joins = (self.pairs[place] == key) & (self.joined[place] < limit)
            out[at[joins]] = False
            first = a > b  # undo the left piece's merge
            more_a, more_b = self.left[a] != a, self.left[b] != b
            undo = np.where(first, more_a, more_b | more_a)
            left = first | ~more_b
            limit = np.where(left, a, b + 1)
            go = ~joins & undo
            a, b = np.where(left, self.right[a], a)[go], np.where(left, b, self.left[b])[go]
            at, limit = at[go], limit[go]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, rank) of every occurrence of every piece."""
        order = suffix_array(codes, self.depth)
        padded = np.concatenate((codes, np.zeros(self.depth + 1, np.uint32)))
        # a slice's suffixes, each cut behind the longest piece, in order
        keys = np.lib.stride_tricks.sliding_window_view(padded, self.depth + 1)[order].view(f"<U{self.depth + 1}").ravel()
        low = np.searchsorted(keys, self.low)
        there = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] < self.high)
        there = there[low[there] < len(keys)]
        low = low[there]
        count = np.searchsorted(keys, self.high[there]) - low
        start = order[np.arange(count.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)]
        ranks = np.repeat(self.sorted[there], count)
        return start, start + self.lengths[ranks], ranks

    def _slice(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(c) for c in chunks])
        base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        start, end, rank = self.edges(codes)
        # relax: step p settles the p-th position of every chunk; -1: nothing, or bytes, before
        label, back = np.full(len(codes) + 1, -1), np.arange(-1, len(codes))
        step = end - np.repeat(base, size + 1)[end - 1]
        longest = int(size.max(initial=0))
        by = step * (self.depth + 1) + end - start
        by = np.argsort(by.astype(np.uint16) if (longest + 1) * (self.depth + 1) < 1 << 16 else by, kind="stable")  # short numbers sort by digits
        start, end, rank = start[by], end[by], rank[by]
        cuts = np.cumsum(np.bincount(step, minlength=longest + 1)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            before = label[start[a:b]]
            fits = before < 0
            ask = np.flatnonzero(~fits)
            fits[ask] = self.stay(before[ask], rank[a:b][ask])
            ok = np.flatnonzero(fits)
            label[end[a:b][ok]], back[end[a:b][ok]] = rank[a:b][ok], start[a:b][ok]  # the last and longest of each end stays
        # all chunks from their ends back at once; several ids of one character are bytes
        at, p, turns = np.arange(len(chunks)), base + size, []
        while len(at):
            go = p > base[at]
            at, p = at[go], p[go]
            turns.append((at, p))
            p = back[p]
        at, p = np.concatenate([x for x, _ in turns]), np.concatenate([x for _, x in turns])
        order = np.argsort(p)  # chunks lie one behind the other
        at, p = at[order], p[order]
        some = np.flatnonzero(label[p] < 0)
        spelled = [[self.byte[c] for c in chr(k).encode("utf-8", "replace")] for k in codes[p[some] - 1].tolist()]
        count = np.ones(len(p), np.int64)
        count[some] = [len(x) for x in spelled]
        ends = np.cumsum(count)
        ids = np.repeat(self.id[label[p]], count)
        for k, x in zip(some.tolist(), spelled):
            ids[ends[k] - len(x) : ends[k]] = x
        return ids, np.bincount(at, count, len(chunks)).astype(np.int64)

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks and how many each has, in slices."""
        out, held, n = [], [], 0
        for k, c in enumerate(chunks):
            held.append(c)
            n += len(c) + 1
            if n >= SLICE or k == len(chunks) - 1:
                out.append(self._slice(held))
                held, n = [], 0
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def starts(self, text: str) -> np.ndarray:
        """Where a text's characters begin a part: the first, and each that stands behind the one before it in no piece."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[np.minimum(codes, len(self.kind) - 1)]
        out = np.ones(len(codes), bool)
        out[1:] = ~self.meet.ravel()[kind[:-1] * len(self.meet) + kind[1:]]
        return out

    def chunk_encoder(self) -> PartEncoder:
        return PartEncoder(self)

    def decode(self, ids: list[int]) -> str:
        """The text of ids of which some are bytes."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        return "".join([*out, held.decode("utf-8", "replace")]).replace(MARK, " ").removeprefix(" ")

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        sizes = np.array([len(x) for x in lists])
        flat = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        parts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.plain.take(pa.array(flat)))
        out = [t.removeprefix(" ") for t in pc.binary_join(parts, "").to_pylist()]
        if len(flat):
            odd = np.flatnonzero(np.isin(flat, self.high_bytes))  # parts of longer characters
            for k in np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist():
                out[k] = self.decode(lists[k].tolist())
        return out


class PartEncoder:
    """Texts from the ids of their parts. index: known parts, a space for each mark, with their rows; seen: in how many batches."""

    MOST = 300_000  # parts that a worker remembers; beyond, the half that most batches had
    LONGEST = 200  # characters of a part that it remembers

    def __init__(self, own: SuffixEncoder):
        self.own, self.index = own, {}
        self.ids, self.ends, self.seen = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _rows(self, parts: list[str]) -> np.ndarray:
        """Rows of distinct parts, new ones too."""
        at = list(map(self.index.get, parts))
        if None in at:
            new = [p for p, x in zip(parts, at) if x is None]
            ids, lengths = self.own.learn([p.replace(" ", MARK) for p in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.ids = np.concatenate((self.ids, ids))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
            self.seen = np.concatenate((self.seen, np.zeros(len(new), np.int64)))
            at = list(map(self.index.get, parts))
        out = np.array(at, np.int64)
        self.seen[out] += 1
        return out

    def _forget(self) -> None:
        """Keep the short parts that most batches had, half of MOST, in their order; what they were seen counts half from now on."""
        parts = list(self.index)
        by = np.lexsort((-np.arange(len(parts)), -self.seen))  # of parts in as many batches the later ones
        short = np.fromiter(map(len, parts), np.int64, len(parts)) <= self.LONGEST
        lengths = np.diff(self.ends)
        kept = by[short[by]][: self.MOST // 2]
        kept = np.sort(kept[np.cumsum(lengths[kept]) <= 4 * self.MOST])
        there = np.zeros(len(parts), bool)
        there[kept] = True
        self.ids = self.ids[np.repeat(there, lengths)]
        self.ends = np.concatenate(([0], np.cumsum(lengths[kept])))
        self.seen = self.seen[kept] // 2
        self.index = {parts[k]: i for i, k in enumerate(kept.tolist())}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids). Null is empty."""
        joined = "".join([" " + t for t in texts if t]).replace(MARK, " ")  # the model puts a mark before a text
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        begin = np.cumsum(size) - size
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.own.starts(joined.replace(" ", MARK))
        starts[begin[size > 0]] = True
        first = np.flatnonzero(starts)
        raw = np.frombuffer(joined.encode(), np.uint8)
        place = first if len(raw) == len(starts) else np.flatnonzero((raw & 0xC0) != 0x80)[first]  # characters begin with no byte 10xxxxxx
        coded = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.append(place, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        at = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.ends[at] - ends[:-1], lengths)]
        if len(self.index) > self.MOST or len(self.ids) > 8 * self.MOST:
            self._forget()
        return ids, ends[np.append(np.searchsorted(first, begin), len(first))]


@cache
def encoder(path: str) -> tuple[SuffixEncoder, PartEncoder]:
    e = SuffixEncoder(path)
    return e, e.chunk_encoder()


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of every row, stored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, chunks = encoder(model)
        for pdf in batches:
            for some in text_slices(pdf, "text", 1_000_000):
                ids, ends = chunks.encode(some["text"].tolist())
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "nameless": some["nameless"].to_numpy(), "ids": np.split(ids, ends[1:-1]) if len(some) else []})

    return materialize(named(nameless(docs).mapInPandas(run, "doc_id long, nameless boolean, ids array<int>")), "pieces")


def decode_ids(coded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, the decoded text and the crc32 of the ids of rows with doc_id and ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, _ = encoder(model)
        for pdf in batches:
            lists = list(pdf["ids"])
            cuts = np.searchsorted(np.cumsum(list(map(len, lists))), np.arange(1_000_000, sum(map(len, lists)), 1_000_000), "right")  # about a million ids at once
            decoded = [t for a, b in zip([0, *cuts], [*cuts, len(lists)]) for t in e.decode_all(lists[a:b])]
            yield pdf.assign(decoded=decoded, ids_crc32=[zlib.crc32(x.astype("<u4").tobytes()) for x in lists])

    return named(nameless(coded, "ids").mapInPandas(run, "doc_id long, nameless boolean, ids array<int>, decoded string, ids_crc32 long"))
