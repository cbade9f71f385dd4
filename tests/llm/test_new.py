"""Curve packing, Merkle manifest and collocations against brute force; edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import audio, collocation, curve, merkle, pii, queries, ranks, token_files

BYTES = tokenizer_path("byte_bpe_50k.json")
BIG = 2**53 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, row string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, null and empty texts, one long text, repeated rows, one hot source, columns with names that operators use."""
    rows = [(None, "no id but SOME words", None, None, 3), (None, None, None, None, None), (None, None, None, None, None), (BIG, "", "x", "", None), (BIG, None, "x", "", 7), (BIG, "Q. q", "x", "", 7), (5, "é ①ﬁ🙂 Ab,ab", "de", "é", 1), (6, " ".join(map(str, range(20000))), "en", "long", 9)]
    rows += [(i, f"Zz {i}", "en", f"s{i % 40}", 2) for i in range(300)] + [(7, "the same text", "en", "hot", 4)] * 280
    return spark.createDataFrame([(*r, 1, "r", 2) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_ranks_give_the_library_s_ids(docs):
    """Chunks of plain and of odd characters, contractions, digits, marks, long runs, white space of all kinds."""
    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    texts = [r["text"] for r in docs.collect()] + ["", " ", "a", "don't they'll WE'RE 'tis", "x" * 3000 + " 1234567 éÉßñ ǆ ①ﬁ🙂", "  two  spaces\n\n new\tline ", "<|endoftext|> a", "\x00 b", "日本 語 ا ب", "\u00ad soft \u200b zero", "!?.,;: ---- ***a***"]
    ids, offsets = ranks.rank_encoder(BYTES, BYTES.replace(".json", ".tiktoken")).encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_hilbert_keys():
    """A key for each cell, and steps along the curve go to neighbours."""
    for dims, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(1 << bits * dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_curve_packing(docs, odd):
    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    for df in (docs, odd, odd.limit(0), odd.where("doc_id = 5")):
        want = collections.Counter((r["doc_id"], tuple([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in df.collect())
        placed = curve.curve_pieces(df, BYTES, ranks=BYTES.replace(".json", ".tiktoken")).collect()
        by = collections.defaultdict(list)
        for r in placed:
            by[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
            assert len(r["ids"]) == 4 * r["length"]
        sizes = []
        for x in by.values():
            at = 0
            for o, n, _ in sorted(x):
                assert o == at
                at += n
            sizes.append(at)
        assert all(n & (n - 1) == 0 and n <= 1024 for n in sizes) and sum(n < 1024 for n in sizes) <= 10  # no padding
        whole = {r["sequence_id"]: bytes(r["ids"]) for r in curve.sequences(curve.curve_pieces(df, BYTES)).collect()}
        assert sum(map(len, whole.values())) == 4 * sum(sizes)
        pieces = collections.defaultdict(list)
        for r in placed:
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        if df is docs:
            for (doc, n), x in pieces.items():
                ids = np.frombuffer(b"".join(b for _, b in sorted(x)), "<u4")
                assert len(ids) == n and want[doc, tuple(ids.tolist())] == 1
        assert sum(n * len(k[1]) for k, n in want.items()) == sum(sizes)


def test_curve_keeps_neighbours(spark):
    """Documents of one topic, of which there are eight, share sequences far more often than chance has it."""
    rng = np.random.default_rng(3)
    words = [[f"w{t}x{i}" for i in range(60)] for t in range(8)]
    rows = [(i, " ".join(rng.choice(words[i % 8], 40))) for i in range(1600)]
    placed = curve.curve_pieces(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).withColumn("topic", F.col("doc_id") % 8)
    share = placed.groupBy("sequence_id", "topic").count().groupBy("sequence_id").agg((F.max("count") / F.sum("count")).alias("s")).agg(F.avg("s")).first()[0]
    assert share > 0.7


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and for each leaf the digests before and behind it, level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(leaves)):
        own, k = [], i
        for level in levels[:-1]:
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            own.append((run[: k % 16], run[k % 16 + 1 :]))
            k //= 16
        paths.append(own)
    return levels[-1][0], paths


def brute_manifest(rows):
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest([*(code(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), code(text)])
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: tree([leaf(r, r["text"]) for r in by[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources]) if sources else ("", [])
    for s, top in zip(sources, tops):
        for r, own in zip(by[s], trees[s][1]):
            here = first = leaf(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                here = leaf(r, lower(r["text"]))
            for a, b in own + top:
                here = digest([*a, here, *b])
            yield r["doc_id"], first, trees[s][0], root, digest(x for a, b in own + top for x in [*a, *b]), here, here == root


def test_merkle_manifest(spark, docs, odd):
    one = odd.where("doc_id = 5")
    many = spark.range(4200).selectExpr("id doc_id", "'T' text", "'en' lang", "'one' source", "id % 3 n_chars")  # four levels
    for df in (docs, odd, one, odd.limit(0), many):
        key = lambda x: tuple(map(str, x))
        got = sorted((tuple(r) for r in merkle.manifest(df).collect()), key=key)
        assert got == sorted(brute_manifest([r.asDict() for r in df.collect()]), key=key)


def brute_phrases(rows, least):
    counts, words = collections.Counter(), collections.Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return {p: n for p, n in counts.items() if n >= least}, words


def brute_collocations(rows, least, report):
    f, words = brute_phrases(rows, least)
    candidates = {p: n for p, n in f.items() if len(p[1]) > 1}
    within = lambda lang, w: any(len(v) > len(w) and m == lang and 100 * n >= 80 * candidates[lang, w] and any(v[i : i + len(w)] == w for i in range(len(v))) for (m, v), n in candidates.items())
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if not within(lang, w):
            score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for lang, found in out.items() for rank, x in enumerate(sorted(found)[:report], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations(spark, docs, odd):
    repeated = [(i, "New York city, New  York\tstate. a a a a a a; é É à l'été à l'été", [None, "en", "fr"][i % 3], "s", 1, 1, "", 2) for i in range(40)]
    for df in (docs, odd.union(spark.createDataFrame(repeated, SCHEMA)), odd.limit(0)):
        rows = [r.asDict() for r in df.collect()]
        assert rows_of(collocation.collocations(df)) == brute_collocations(rows, 30, 2000)
        assert rows_of(collocation.collocations(df, 12, 5)) == brute_collocations(rows, 12, 5)


def test_small_sketches_lose_nothing(spark, docs, monkeypatch):
    """With far more phrases than cells, estimates rise and all that is frequent still comes through; merged counters stop at their end."""
    rows = [r.asDict() for r in docs.collect()]
    want, _ = brute_phrases(rows, 30)
    sketch = collocation.Sketch(30, np.zeros((2, 1 << 25), np.uint8))
    grams = np.repeat(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), [29, 30, 700])
    sketch.add(grams)
    sketch.add(grams[:10])
    assert sketch.reaches(np.unique(grams), 39).sum() == 2 and sketch.counters.max() == 255
    got, _ = collocation.frequent_phrases(docs.repartition(6))
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["a"] for r in got.collect()} == want
    full = dict.fromkeys(range(256), zlib.compress(b"\xff" * (1 << 18)))
    with collocation.sent(spark, full) as (everything,):
        texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
        counts = collocation.count_survivors(texts, everything, everything, 30, most=1000).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where("a >= 30").collect()
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["a"] for r in counts} == want


def test_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    a, l, r = 3 * 10**13 + 1, 4 * 10**13, 5 * 10**13 + 7
    phrases = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, size int, phrase string, a long")
    row = collocation.scored(phrases.where("size = 2"), phrases).first()
    assert (row["l"], row["r"], row["score"]) == (l, r, 2000000 * a // (l + r))
    assert collocation.without_subsumed(phrases).count() == 1


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_collocations"])
def test_sql(name, spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = c.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(*columns).fetchall())


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_dense_shapes_end(spark, share):
    """All or half of a shape's strings are real entities: surrogates stay distinct, consistent and other than what they replace."""
    mails = [f"{d}@{e}.co" for d in range(10) for e in range(10)][: int(100 * share)]
    df = spark.createDataFrame([(i, f"mail {m} now, again {m}") for i, m in enumerate(mails)], "doc_id long, text string").repartition(3)
    new = {}
    for r in pii.replace_private(df, "a secret").collect():
        own = {e["surrogate"] for e in r["entities"]}
        assert len(own) == 1 and len(r["entities"]) == 2
        new[mails[r["doc_id"]]] = own.pop()
    assert len(set(new.values())) == len(mails) and all(a != b for a, b in new.items())
    if share < 1:
        assert sum(b in new for b in new.values()) <= 5  # of fifty, few are real entities


def test_stored_tensors(docs):
    """The stored tensors are the mel energies of the stored samples, by a plain transform of each frame, with spans that follow each other."""
    media = audio.store_audio(docs.where("doc_id < 12"))
    samples = {r["doc_id"]: audio.wav_samples(bytes(r["media"]))[0] for r in media.collect()}
    for r in audio.store_features(media).collect():
        x = (np.frombuffer(samples[r["doc_id"]], np.uint8).astype(np.float32) - 128) / 128
        mel = audio.log_mel(audio.resample(x))
        blocks, spans = audio.tensors(bytes(r["tensors"]))
        assert blocks.shape[1:] == (audio.ROWS, audio.MELS) and np.array_equal(blocks.reshape(-1, audio.MELS)[: len(mel)], mel) and r["n_frames"] == len(mel)
        assert np.allclose(spans[1:, 0], spans[:-1, 1]) and all(s["start_s"] < s["end_s"] for s in r["spans"])


def test_token_files_by_ranks(docs, odd):
    """Files from ranks hold the ids that files from the library hold."""
    for df in (docs, odd):
        plain, fast = (sorted(map(str, token_files.read_token_files(token_files.write_token_files(df, BYTES, ranks=r)).collect())) for r in (None, BYTES.replace(".json", ".tiktoken")))
        assert plain == fast and len(fast) == df.count()
