"""Work for a row and for a list: whole results, and expressions that are computed once."""

import random

import duckdb
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from quillon.functions.text import key_values
from quillon.llm import sp_suffix, windows
from quillon.operators import facets, index
from quillon.plans.registry import ORACLE_SQL, QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """1500 parts of one type, at few prices."""
    d = str(tmp_path_factory.mktemp("parts"))
    spark.range(1500).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "red").otherwise("old"), F.lit("ring")).alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 7).alias("p_brand"), F.lit("PROMO").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), (900 + F.col("id") % 11 / 2).alias("p_retailprice")).coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_rank_decay_whole(spark, parts):
    """every row of a list of 1500 has its place."""
    got = sorted(map(tuple, QUERIES["rank_decay"](spark, parts).collect()))
    want = duckdb.sql(f"with part as (select * from '{parts}/part.parquet/*.parquet') select p_type, p_partkey, round(greatest(0.0, 1 - (r - 1) / greatest(10, n - 1)::DOUBLE), 6) from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as r, count(*) over (partition by p_type) as n from part)").fetchall()
    assert len(got) == 1500 and got == sorted(want)


def test_key_values_once(spark):
    """the block's pattern stands in the plan once, for any number of keys and uses."""
    df = spark.createDataFrame([("a: 1 - b: 2 - a: 3 - b:",)], "t string")
    kv = key_values(F.col("t"), ["a", "b"])
    assert df.select(kv).first()[0] == {"a": "3", "b": "2"}
    tables = {n: {"x": "y"} for n in ("silhouette", "neckline", "sleeve", "pattern", "waist", "position", "shoulder", "detail", "occasion", "season")}
    for made in (kv, facets.block_facets(kv, tables, ["lace"])):
        assert plan_of(df.select(made.alias("x"))).count("(?i)(a|b)") == 1


@pytest.mark.parametrize("name", ["kv_facets", "kv_block_parse", "garment_facets", "material_parse"])
def test_costly_rows_are_dealt(spark, parts, name):
    """rows of one small file are worked on in many tasks."""
    out = QUERIES[name](spark, parts)
    assert spark.read.parquet(f"{parts}/part.parquet").rdd.getNumPartitions() == 1 < out.rdd.getNumPartitions()
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{parts}/part.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, out.select(sorted(out.columns)).collect()))) == sorted(map(repr, con.sql(f"select {', '.join(sorted(out.columns))} from ({ORACLE_SQL[name]})").fetchall()))


def test_name_once(spark):
    """the texts that all rule tables search are made once."""
    df = spark.createDataFrame([("Red Mini Dress", "Fit: Slim.")], "n string, d string")
    name = F.initcap(F.lower("n"))
    assert plan_of(df.select(facets.facets(name, F.col("d")).alias("x"))).count("initcap") <= 2


def test_postings_within_documents(spark):
    """F6 to F10: places of terms of a document of several rows, null and empty ones; no token is a row on the way."""
    df = spark.createDataFrame([(1, [["b", "a", "b"], None, ["c", "a"]]), (2, [[]]), (3, [None])], "i int, l array<array<string>>")
    got = {r["i"]: {p["term"]: (p["dl"], p["gaps"]) for p in r["p"]} for r in df.select("i", index.postings_of(F.col("l")).alias("p")).collect()}
    assert got == {1: {"a": (3, [1, 0]) if got[1]["a"][0] == 3 else (2, [1, 0]), "b": (3, [0, 2]), "c": (2, [0])}, 2: {}, 3: {}}


def test_shards_grow_with_the_table():
    """a bucket holds some megabytes of files, whatever the table's size, so a task's memory is bounded."""
    assert index.SHARD_BYTES <= 16 << 20


def test_grades_are_not_sent_to_all(spark, sf_dir):
    """no broadcast of the grades of all pages."""
    df = QUERIES["boost_sweep"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "row_number" not in plan and plan.count("strategy=broadcast") == 1


def test_repeat_of_a_second_place(spark):
    """the earlier document has a phrase twice and its windows' first place is not where the passage is; 39 of 120 were lost."""
    r = random.Random(3)
    w = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    docs = []
    for g in range(120):
        x, c, d = w(47), w(3), w(3)
        docs += [(2 * g + 1, " ".join(w(40) + x + w(60) + c + x + d + w(40))), (2 * g + 2, " ".join(w(30) + c + x + d + w(30)))]
    got = windows.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((p["doc_id"], p["source_id"]) for p in got if p["end_word"] - p["start_word"] >= 53) == [(2 * g + 2, 2 * g + 1) for g in range(120)]


def test_common_passage_rows(spark, monkeypatch):
    """a passage of very many documents is a few rows for each of them between steps, not one for each window (twelve here)."""
    r, made, keep = random.Random(4), {}, windows.materialize
    w = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    common = w(65)
    docs = [(i, " ".join(w(20) + common + w(20))) for i in range(400)]

    def counted(df, name, *codec):
        out = keep(df, name, *codec)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(windows, "materialize", counted)
    got = windows.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((p["doc_id"], p["source_id"], p["start_word"], p["end_word"]) for p in got) == [(i, 0, 20, 85) for i in range(1, 400)]
    assert {n: k for n, k in made.items() if k > 8 * len(docs)} == {}


def test_known_chunks_are_not_encoded_again():
    """F2, op8: words that a worker remembers aren't indexed again with a mark behind them; ids are the library's."""
    from sentencepiece import SentencePieceProcessor

    model = tokenizer_path("piece_bpe_32k.model")
    plain, marked = [("wonderful strangers Zürich 漢字 \U0001f600 first" + m).replace(" ", m + " ") for m in ("", ",")]
    odd = ["▁ \0first\0wonderful  x", "\0first\0strangers, a", " ", "", "a" * 70000]
    own = sp_suffix.SuffixEncoder(model)
    chunks, asked, learn = own.chunk_encoder(), [], own.learn
    own.learn = lambda parts: asked.extend(parts) or learn(parts)
    library = SentencePieceProcessor(model_file=model)
    for texts in (["so " + plain + " end"], ["so " + marked + " end"], odd):
        ids, ends = chunks.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library.encode(texts)
    assert asked.count("▁wonderful") == asked.count("▁strangers") == 1


def test_parts_that_batches_share_stay_known():
    """F1 of round 3, op8: texts are cut wherever no piece goes on, and what batches share stays known though single words fill the
    worker's memory; before, a word and the next line's first were one chunk, and words that came late were encoded in each batch."""
    from sentencepiece import SentencePieceProcessor

    model = tokenizer_path("piece_bpe_32k.model")
    own = sp_suffix.SuffixEncoder(model)
    chunks, asked, learn = own.chunk_encoder(), [], own.learn
    chunks.MOST = 600
    singles = [f"{a}{b}{c}{d}{e}le" for a in "bdfgk" for b in "aeiou" for c in "xzwvtsqpnm" for d in "aeiou" for e in "rstn"]
    own.learn = lambda parts: asked.extend(parts) or learn(parts)
    library = SentencePieceProcessor(model_file=model)
    shared = "wonderful strangers.\nMarvellous 漢字漢 first"
    for k in range(40):
        single = " ".join(singles[1000 + 100 * k : 1100 + 100 * k] if k else singles[:1000])
        odd = "\x00\n\U0001f600" + "-" * 300 + " ▁  7f3a" + "a" * 300 + " "
        texts = [f"{single} {shared}", None, "", shared.replace(" ", ".\n"), odd] if k else [single]
        ids, ends = chunks.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library.encode([t or "" for t in texts])
        assert len(chunks.index) <= 600
    assert [sum(w in p for p in asked) for w in ("▁wonderful", "▁strangers", "Marvellous", "漢")] == [1, 1, 1, 1]
