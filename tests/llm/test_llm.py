"""The corpus operators against brute force, libraries and round trips; edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import audio, mtree, ngram_join, packing, pii, quality, sharding, sp_suffix, storage, textbatch, token_files, tokens, windows

P = tokenizer_path("word_bpe_49k.json").rpartition("/")[0]
BIG = 2**53 + 1
ODD = [None, "", " ", "a", "a b", "A  b\t\nc ", "x" * 5000, "é ①ﬁ🙂 ▁a", "\x1c!a \x1d", "the same text of many words " * 30, "the same text of many words " * 30, "tied tied", "tied tied", " ".join(map(str, range(30000)))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(BIG if i == 3 else i, t, "other", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, _group int").repartition(3)


@pytest.fixture(scope="module")
def lost(spark):
    """Null ids beside large ones, repeated rows, columns with names that operators use."""
    rows = [(None, "no id but some words here", 1, None, "e", 1), (BIG, "a text of its own", 2, 5, "e", 2), (None, None, None, None, None, None), (BIG, "a text of its own", 2, 5, "e", 2), (7, "", 3, 6, "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, n_chars long, entities string, shard int").coalesce(1)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_audio(docs, odd, empty):
    for df in (docs, odd, empty):
        want = texts(df)
        got = audio.document_audio(df).collect()
        assert len(got) == len(want)
        for r in got:
            b = want[r["doc_id"]].encode()
            b = b.ljust(max(192, -(-len(b) // 192) * 192))
            assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(b).hexdigest(), zlib.crc32(b[-16:]), len(b))
    x = np.sin(np.arange(8000) / 9).astype(np.float32)
    y = audio.resample(x)
    assert len(y) == 5000 and np.abs(y[200:-200] - np.sin((np.arange(5000) * 8 / 5 - 6.4 / 1) / 9)[200:-200]).max() < 0.2
    mel = audio.log_mel(y)
    blocks, spans = audio.tensors(audio.tensor_ipc(mel))
    assert np.array_equal(blocks.reshape(-1, audio.MELS)[: len(mel)], mel) and (np.diff(spans, axis=1) > 0).all()
    assert audio.segments(np.array([0, 0, 9, 4.6, 9, 0, 0.0])).tolist() == [[2, 5]]


def check_packed(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    return len(by)


def test_packing(docs, odd, empty):
    tok = Tokenizer.from_file(f"{P}/word_bpe_49k.json")
    tok.encode_special_tokens = True
    for df in (docs, odd, empty):
        want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts(df).items()}
        rows = packing.pack_documents(df, f"{P}/word_bpe_49k.json").collect()
        got = collections.defaultdict(dict)
        for r in rows:
            own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            got[r["doc_id"]][r["piece"]] = r["length"]
        assert {i: sum(x.values()) for i, x in got.items()} == {i: len(x) for i, x in want.items()}
        n = check_packed(rows)
        assert n <= 1.03 * sum(map(len, want.values())) / 2048 + 2
    where, _ = packing.sum_of_squares(np.array([6, 4, 3, 3, 2, 2]), 10)
    assert where.max() == 1
    for capacity, n in ((20, 300), (100, 1000)):  # each choice against all choices
        lengths = np.random.default_rng(n).integers(1, capacity + 1, n)
        where, offset = packing.sum_of_squares(lengths, capacity)
        gaps = collections.Counter()
        for k in np.argsort(-lengths, kind="stable").tolist():
            s, g = int(lengths[k]), capacity - int(offset[k])

            def cost(gap, s=s):
                after = gaps.copy()
                if gap < capacity:
                    after[gap] -= 1
                if gap > s:
                    after[gap - s] += 1
                return sum(x * x for x in after.values())

            assert cost(g) == min(cost(x) for x in {capacity, *(x for x, many in gaps.items() if many and x >= s)})
            if g < capacity:
                gaps[g] -= 1
            if g > s:
                gaps[g - s] += 1


def test_shards(docs, odd, empty):
    for df in (docs, odd, empty):
        want = texts(df)
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == len(want)
        slots, size = collections.defaultdict(list), collections.Counter()
        for r in rows:
            assert r["size"] == len(want[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(want[r["doc_id"]].encode())
            slots[r["shard"]].append(r["slot"])
            size[r["shard"]] += r["size"]
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        if df is docs:
            assert len(size) == 8 and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in rows)


def test_shards_hot_group(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    same = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one row").alias("text"))
    for x in (df, same):
        size = [r["b"] for r in sharding.shard_documents(x).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
        assert len(size) == 8 and max(size) - min(size) < 0.02 * sum(size)


def brute_groups(t, width, num, den):
    sets = {}
    for i, x in t.items():
        w = x.encode("utf-8", "replace").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_pairs(spark, monkeypatch):
    """Two thousand near copies, linking and just not linking, make no more candidates than postings."""
    made = []
    real = ngram_join.materialize

    def watch(df, name, *more):
        out = real(df, name, *more)
        if name in ("postings", "links"):
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", watch)
    draw = random.Random(1)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(2000):
        w = list(base)
        for k in draw.sample(range(120), 1 if i % 2 else 5):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(118)} for i, t in rows}
    odd = [i for i in sets if i % 2]
    assert all(10 * len(sets[1] & sets[i]) < 9 * len(sets[1] | sets[i]) or got[i] == got[1] for i in odd)
    assert sum(n for name, n in made if name == "links") <= made[0][1]


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, docs, odd, empty, width, num, den):
    draw = random.Random(width)
    base = [f"w{draw.randrange(4000)}" for _ in range(150)]
    near = []
    for i in range(120):  # a group of near copies, some too far for any link
        w = list(base)
        for _ in range(draw.randrange(6)):
            k = draw.randrange(len(w))
            w[k : k + 1] = draw.choice([[w[k] + "x"], [], [w[k], "new"]])
        near.append((i, " ".join(w)))
    for df in (docs, odd, empty, spark.createDataFrame(near, "doc_id long, text string")):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, width, num, den).collect()}
        assert got == brute_groups(texts(df), width, num, den)


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_short(spark, width, num, den):
    draw, t, want = random.Random(width), {}, {}
    for i in range(0, 6000, 2):  # pairs of 5 to 30 words that differ by one word, each pair with words of its own
        w = [f"p{i}w{k}" for k in range(draw.randrange(5, 31))]
        k = draw.choice([0, len(w) - 1, draw.randrange(len(w))])
        other = w[:k] + draw.choice([[], ["x"], [w[k], "x"]]) + w[k + 1 :]
        pair = {i: " ".join(w), i + 1: " ".join(other)}
        t |= pair
        want |= brute_groups(pair, width, num, den)
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, width, num, den).collect()}
    assert {i: (got.get(i), x) for i, x in want.items() if got.get(i) != x} == {} and len(got) == len(want)


def test_passages(spark, odd, empty):
    draw = random.Random(3)
    word = lambda n: [f"v{draw.randrange(10**6)}" for _ in range(n)]
    shared = word(70)
    rows = [(i, " ".join(word(draw.randrange(40, 300)) + (shared if i % 3 == 0 else []) + word(30))) for i in range(60)]
    changed = list(shared)
    changed[35] = "other"
    rows.append((60, " ".join(word(20) + changed + word(20))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = windows.repeated_passages(df)
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in found.collect()}
    t = {i: x.split() for i, x in rows}
    assert set(got) == {i for i in range(1, 60) if i % 3 == 0} | {60}
    assert all(t[i][a:b] == shared for i, (a, b) in got.items() if i < 60)
    left = texts(windows.without_repeats(df, found))
    assert shared[0] in left[0] and all(shared[0] not in left[i].split() for i in got)
    for x in (odd, empty):
        windows.without_repeats(x, windows.repeated_passages(x)).collect()


def test_windows_cover():
    for values in (200, 9):  # without and with ties
        h = textbatch.mix64(np.random.default_rng(1).integers(1, values**3 if values > 9 else values, 200).astype(np.uint64))
        w = windows.compact_windows(h, 20).tolist()
        for a in range(0, 180, 7):
            for b in range(a + 20, 200, 11):  # each long enough passage lies in the window of each of its minima
                for c in (a + np.flatnonzero(h[a:b] == h[a:b].min())).tolist():
                    assert [x for x in w if x[0] <= a and b - 1 <= x[2] and x[1] == c]


def spans_of(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append((r["start_word"], r["end_word"]))
    return out


def brute_repeats(t, width=50):
    """(doc_id, word) of each run of `width` words that an earlier document has."""
    seen, out = set(), []
    for i in sorted(t):
        w = t[i].lower().split()
        own = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
        out += [(i, k) for k, g in enumerate(own) if g in seen]
        seen.update(own)
    return out


@pytest.mark.parametrize("kind", ["random", "boilerplate", "few words"])
def test_passages_recall(spark, kind):
    """Exact repeats are all found, near ones (one word in 60 changed) to nine tenths at least, however rows are dealt."""
    draw = random.Random(kind)
    vocabulary = 30 if kind == "few words" else 10**6
    word = lambda n: [f"v{draw.randrange(vocabulary)}" for _ in range(n)]
    lines = [word(20) for _ in range(3)]
    shared = [word(60) for _ in range(40)]
    rows, near = [], []
    for i in range(200):
        w = word(draw.randrange(30, 200))
        if kind == "boilerplate":
            w += draw.choice(lines) + word(5)
        p = list(shared[i % 40])
        if i >= 160:
            p[draw.randrange(60)] = "changed"
            near.append((i, len(w)))
        rows.append((i, " ".join(w + (p if i >= 80 or i < 40 else []) + word(20))))
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        found.append(sorted(map(tuple, windows.repeated_passages(df).collect())))
    assert found[0] == found[1]
    got = spans_of(windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(i, k) for i, k in brute_repeats(dict(rows)) if not any(a <= k and k + 50 <= b for a, b in got[i])] == []
    if kind != "few words":
        assert sum(any(a <= k + 5 and k + 55 <= b for a, b in got[i]) for i, k in near) >= 0.9 * len(near)


def test_passages_behind_phrases(spark):
    draw = random.Random(5)
    word = lambda n: [f"v{draw.randrange(10**6)}" for _ in range(n)]
    p = word(70)
    rows = [(k, " ".join(word(60) + p[5 * k : 5 * k + 5] + word(60))) for k in range(14)] + [(50, " ".join(p[:25] + word(3) + p[25:48] + word(60)))]
    rows += [(i, " ".join(word(60) + p + word(30))) for i in (100, 101)]
    got = spans_of(windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert (60, 130) in got[101]


def test_top_k(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    hot = df.where("vec_id = 3").select(F.explode(F.expr("sequence(10000L, 10040L)")).alias("vec_id"), "embedding", "label")
    bad = spark.createDataFrame([(20000, None, 1), (20100, [float("nan")] * 64, 1), (None, [1.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    v = mtree.integer_vectors(df.unionByName(hot).unionByName(bad))
    rows = v.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    got = collections.defaultdict(list)
    for r in mtree.top_k(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in ids[ids % 100 == 0]:
        s = x @ x[ids == q][0]
        assert got[q] == sorted(((int(a), int(i)) for a, i in zip(s, ids) if i != q), key=lambda p: (-p[0], p[1]))[:10]
    assert mtree.top_k(v.limit(0), v.limit(0)).count() == 0
    huge = mtree.integer_vectors(spark.createDataFrame([(1, [1e30, 1.0]), (2, [1.0, 2.0]), (3, [0.5, 2.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in mtree.top_k(huge, huge.where("vec_id = 2")).collect()] == [(2, 1, 3, 512 * 1024 + 2048 * 2048)]


def test_top_k_trees(spark, monkeypatch):
    """Many small trees with the same answers; distances exclude a part of the visits."""
    monkeypatch.setattr(mtree, "TREE", 64)
    monkeypatch.setattr(mtree, "PIVOTS", 8)
    draw = np.random.default_rng(2)
    x = (draw.normal(size=(20, 4))[draw.integers(0, 20, 3000)] * 40 + draw.normal(size=(3000, 4))).astype(float)
    v = mtree.integer_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    y = np.floor(1024 * x).astype(np.int64)
    got = collections.defaultdict(list)
    for r in mtree.top_k(v, v.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in range(0, 3000, 100):
        assert got[q] == sorted(((int(a), i) for i, a in enumerate(y @ y[q]) if i != q), key=lambda p: (-p[0], p[1]))[:10]


def test_token_files(docs, odd, empty):
    tok = Tokenizer.from_file(f"{P}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    for df in (docs, odd, empty):
        want, at = {}, 0
        for i, t in sorted(texts(df).items()):
            ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
            want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        got = token_files.read_token_files(token_files.write_token_files(df, f"{P}/byte_bpe_50k.json"))
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
    files = token_files.write_token_files(docs, f"{P}/byte_bpe_50k.json")
    got = {r["doc_id"]: r["ids"] for r in token_files.read_documents(files, docs.where("doc_id % 40 = 0")).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts(docs.where("doc_id % 40 = 0")).items()}
    image = token_files.pack_file([(k, np.arange(k * 1000, dtype=np.uint32)) for k in range(40)])
    assert token_files.TokenFile(image).ids(7).tolist() == list(range(7000))
    with pytest.raises(Exception):  # noqa: B017
        token_files.TokenFile(image[:50] + bytes([image[50] ^ 255]) + image[51:]).ids(3)


def test_chunks_forget():
    e = tokens.ChunkEncoder(tokens.Library(f"{P}/byte_bpe_50k.json", "byte"), " ", "", tokens._RUN)
    e.MOST = 10
    tok = Tokenizer.from_file(f"{P}/byte_bpe_50k.json")
    for part in (ODD, ["it's  we'll ! ?\n\n x", "a   b\n  c"], ODD):
        ids, ends = e.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in part]
        assert len(e.index) <= 10


def test_sentencepiece(docs, odd, empty):
    model = f"{P}/piece_bpe_32k.model"
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for df in (docs, odd, empty):
        want = texts(df)
        for r in sp_suffix.decode_ids(sp_suffix.encode_documents(df, model), model).collect():
            assert r["ids"] == sp.encode(want[r["doc_id"]]) and r["decoded"] == want[r["doc_id"]].replace("▁", " ")


def test_surrogates(spark, odd, empty):
    rows = [
        (1, "Mail bob.7@mail2.example.com or BOB.7@MAIL2.EXAMPLE.COM, call +1 (743) 555-3824."), (2, "bob.7@mail2.example.com 10.1.2.3 4111 1111 1111 1111 and 4785380592391139"),
        (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Mrs. Anna Smith met г-н Иван Петров, 10.1.2.3'), (4, None), (5, "nothing 12 34"),
    ]
    got = {r["doc_id"]: r for r in pii.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    by = lambda i, kind: [e["surrogate"] for e in got[i]["entities"] if e["kind"] == kind]
    assert by(1, "email")[0] == by(1, "email")[1].lower() == by(2, "email")[0] != "bob.7@mail2.example.com" and by(1, "email")[1].isupper()
    assert by(2, "ip") == by(3, "ip") != ["10.1.2.3"]
    assert [len(x) for x in by(2, "card")] == [19, 16] and pii.luhn(by(2, "card")[0].replace(" ", ""))
    assert by(1, "phone")[0].startswith("+1 (") and "555-" in by(1, "phone")[0]
    woman, man = by(3, "person")
    assert woman.split()[1] in pii.GIVEN["latin", "f"] and man.split()[1] in pii.GIVEN["cyrillic", "m"]
    assert got[4]["text"] is None and got[5]["text"] == rows[4][1] and not any(x in got[3]["text"] for x in ("24be64", "Smith", "Петров"))
    many = [(k, f"user{k}.{k % 97}@mail{k % 9}.example.com") for k in range(3000)]
    out = [r["entities"][0]["surrogate"] for r in pii.replace_private(spark.createDataFrame(many, "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == 3000
    names = [(k, f"Ms. {a} {b}") for k, (a, b) in enumerate((a, b) for a in ("Ada", "Bea", "Cleo", "Dina", "Eva", "Fay") for b in ("Li", "Wu", "Xu", "Oz"))]
    out = [r["entities"][0]["surrogate"] for r in pii.replace_private(spark.createDataFrame(names, "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == len(names)
    for df in (odd, empty):
        assert pii.replace_private(df, "k").count() == df.count()


def test_surrogates_people(spark):
    rows = [(1, "Mr John Smith met Mr Smith. Later John Smith's friend saw Smith and John; Smithson stayed."), (2, "Dr Maria Garcia Lopez, then Lopez and Mrs Smith."), (3, "Smith alone"), (4, "Mr Éá and _@-.com")]
    got = {r["doc_id"]: r for r in pii.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    _, given, sur, *_ = got[1]["text"].split()
    assert got[1]["text"] == f"Mr {given} {sur} met Mr {sur}. Later {given} {sur}'s friend saw {sur} and {given}; Smithson stayed."
    assert not any(x in got[2]["text"] for x in ("Maria", "Garcia", "Lopez", "Smith")) and got[2]["text"].endswith(f"Mrs {sur}.") and got[3]["text"] == "Smith alone"
    assert not any(x in got[4]["text"] for x in ("Éá", "_@-.com"))
    perm = [pii._derange(x, 700, b"k", b"t") for x in range(700)]
    assert sorted(perm) == list(range(700)) and all(x != y for x, y in enumerate(perm))


def test_surrogates_real(spark):
    """No surrogate is another real entity; letters outside the base alphabets change too; names keep their marks."""
    real = [(k, f"id 1.0.{k // 250}.{k % 250}") for k in range(500)]
    first = {pii.surrogate("ip", t[3:], pii._key("k")) for _, t in real}
    rows = real + [(1000 + k, f"id {x}") for k, x in enumerate(sorted(first)[:200])]
    got = pii.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    out = [r["entities"][0]["surrogate"] for r in got]
    assert len(set(out)) == len(out) and not set(out) & {t[3:] for _, t in rows}
    names = spark.createDataFrame([(1, "Mr. Åé met Herr Öß and κ. Άώ; Mr Sean O'Brien came."), (2, "number 1234567890123 stays")], "doc_id long, text string")
    a, b = (r["text"] for r in pii.replace_private(names, "k").orderBy("doc_id").collect())
    assert not any(x in a for x in ("Åé", "Öß", "Άώ", "Brien", "Sean")) and b == "number 1234567890123 stays"
    with pytest.raises(ValueError):
        pii.replace_private(names, "")


def test_surrogates_many_given(spark):
    names = [f"{a}{b}{c}" for a in "BCDF" for b in "aeiou" for c in "lmnrst"]
    rows = [(k, f"Ms. {n} Li and Dr {n} Li, Ms. {n} Wu", k) for k, n in enumerate(names)]  # more of one surname than there are given names
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")
    near, far = ({r["doc_id"]: r for r in pii.replace_private(df, "k", most=most).collect()} for most in (100_000, 10))
    assert near == far and len({e["surrogate"] for r in near.values() for e in r["entities"]}) == 3 * len(names)


def test_quality(spark, sf_dir, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in rows]) > 0.95
    for df in (odd, empty):
        assert all(0 <= r["score"] <= 1 for r in quality.score(df, model).collect())
    none = quality.train(docs, labels.where("quality = 1"))
    assert all(r["score"] == 0.5 for r in quality.score(odd, none).collect())


def test_lost_rows(spark, lost):
    """Rows without doc_id, large ids, repeats and clashing columns: nothing is lost or changed on the way."""
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    want, model = ids(lost), f"{P}/piece_bpe_32k.model"
    files = token_files.write_token_files(lost, f"{P}/byte_bpe_50k.json")
    for out in (
        audio.document_audio(lost), packing.pack_documents(lost, f"{P}/word_bpe_49k.json"), sharding.shard_documents(lost), ngram_join.jaccard_groups(lost), token_files.read_token_files(files),
        sp_suffix.decode_ids(sp_suffix.encode_documents(lost, model), model), pii.replace_private(lost, "k"), windows.without_repeats(lost, windows.repeated_passages(lost)),
    ):
        assert ids(out) == want
    private = pii.replace_private(lost, "k")
    assert private.columns == [*lost.columns, "entities_"] and {r["entities"] for r in private.collect()} == {"e", "x", None}
    assert {r["component_id"] for r in ngram_join.jaccard_groups(lost).collect()} == {None, BIG, 7}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert check_packed(rows) and len({r["doc_id"] for r in rows}) > 600
    odd = spark.createDataFrame([(i, t, "en", "s", 1, 5) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for name, stage in corpus_pipeline.STAGES:
        columns, odd = odd.columns, storage.materialize(stage(spark, odd, sf_dir), "odd")
        assert name == "packing" or odd.columns == columns
    assert odd.count()
