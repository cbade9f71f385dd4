"""Sanitisers, search fields, refresh of changed rows, resumable backfill."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import sanitize, upkeep


def test_picks(spark):
    long = "x" * 95
    answers = [(-1.0, "out of range below"), (0.9, "cotton with pockets, null"), (0.0, "a repeated index"), (4.0, "out of range above"), (2.0, "null"), (3.0, "Great for summer days"), (1.0, long), (None, "no index at all")]
    schema = "n int, r array<struct<index: double, reason: string>>"
    rows = spark.createDataFrame([(4, answers), (4, None), (0, answers), (99, [(float(i), f"reason number {i}") for i in range(20)])], schema)
    got = [[tuple(x) for x in r[0]] for r in rows.select(sanitize.picks(F.col("r"), F.col("n"))).collect()]
    assert got[0] == [(0, "cotton with pockets"), (2, None), (3, None), (1, "x" * 87 + "...")]
    assert got[1] == [] and got[2] == [] and [i for i, _ in got[3]] == list(range(10))


def test_expansion(spark):
    raw = "r struct<terms: array<string>, negatedTerms: array<string>, hasNegation: boolean, type: string, colors: array<string>>"
    rows = [((["  Linen ", "a", "one two three", "one two three four", None] + [f"t{i}" for i in range(30)], [" Wool", " "], None, "Mini_Dress", ["RED", "nope", "red", None]),), ((None, None, True, "boat", None),), ((None, None, None, None, None),)]
    got = [r[0] for r in spark.createDataFrame(rows, raw).select(sanitize.expansion(F.col("r"), {"type": ["mini-dress"]}, {"colors": ["red", "blue"]})).collect()]
    assert got[0]["terms"] == ["linen", "one two three"] + [f"t{i}" for i in range(18)]
    assert (got[0]["facets"], got[0]["negated"], got[0]["has_negation"]) == ({"type": ["mini-dress"], "colors": ["red"]}, ["wool"], True)
    assert (got[1]["terms"], got[1]["facets"], got[1]["has_negation"]) == ([], {}, True) and got[2]["has_negation"] is False


def test_extraction(spark):
    rows = [(("mini dress", ["red", "puce", None]),), (("boat", None),), ((None, []),)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "r struct<type: string, colors: array<string>>").select(sanitize.extraction(F.col("r"), {"type": ["mini-dress"]}, {"colors": ["red"]})).collect()]
    assert got == [("mini-dress", ["red"], 2), (None, [], 1), (None, [], 0)]


def test_resolve(spark):
    rows = spark.createDataFrame([("a", "b", "c", "d", ["x", "y"], ["y", "z"]), (None, "b", "c", None, None, ["z"]), ("b", "b", None, None, None, None)], "ta string, va string, tb string, vb string, tl array<string>, vl array<string>")
    values, conflicts = sanitize.resolve({"shape": F.col("ta"), "kind": F.col("tb")}, {"shape": F.col("va"), "kind": F.col("vb")}, ["shape"], ["kind"])
    got = rows.select(values["shape"], values["kind"], F.transform(conflicts, lambda c: c["field"]), sanitize.union(F.col("vl"), F.col("tl"))).collect()
    assert [tuple(r) for r in got] == [("b", "c", ["shape", "kind"], ["y", "z", "x"]), ("b", "c", [], ["z"]), ("b", None, [], [])]


def test_search_fields(spark):
    rows = spark.createDataFrame([("Name", "Red", "mini", ["red", None], "95% cotton", ["elastane"], ["knit"], "Some  copy " + "word " * 200, None), (None, "", None, None, None, None, None, "", "Fits small")], "n string, v string, f string, l array<string>, m string, fi array<string>, fa array<string>, d string, o string")
    c = F.col
    got = [r[0] for r in rows.select(upkeep.search_fields(c("n"), c("v"), [c("f")], [c("l")], c("m"), c("fi"), c("fa"), c("d"), c("o"), {"elastane": ("Stretchy", "elastane"), "mini": ("mini", "short")})).collect()]
    assert (got[0]["title"], got[0]["attrs"], got[0]["material"]) == ("name red", "mini short red knit", "95% cotton stretchy elastane knit")
    assert got[0]["body"].startswith("some copy word") and len(got[0]["body"]) <= 600 and got[0]["body"].endswith("word")
    assert tuple(got[1]) == ("", "", "", "fits small")


def test_refresh(spark):
    """Only changed and new rows are derived again; the others are kept, and rows without inputs go."""
    table = lambda *rows: spark.createDataFrame(rows, "id int, a string, b int")
    derive = lambda df: df.select("id", F.concat_ws("-", "a", "b").alias("text"))
    values = lambda r: {x["id"]: x["text"] for x in r.rows.collect()}
    first = upkeep.refresh(None, table((1, "x", 1), (2, None, 2), (3, "z", None)), "id", derive)
    assert first.computed == 3 and values(first) == {1: "x-1", 2: "2", 3: "z"}
    second = upkeep.refresh(first.rows, table((1, "x", 1), (2, "", 2), (4, "n", 4)), "id", derive)
    assert second.computed == 2 and values(second) == {1: "x-1", 2: "-2", 4: "n-4"}
    third = upkeep.refresh(second.rows, table((1, "x", 1), (2, "", 2), (4, "n", 4)), "id", derive)
    assert third.computed == 0 and values(third) == values(second)
    assert upkeep.refresh(third.rows, table(), "id", derive).rows.count() == 0


def test_backfill(spark, tmp_path):
    """Stopped half-way and resumed: every row once, finished batches not derived again."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(4):
        spark.createDataFrame([(k * 10 + i, k) for i in range(5)], "id int, k int").coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    done = []

    def derive(df, broken=False):
        ks = [r["k"] for r in df.select("k").distinct().collect()]
        if broken and len(done) == 2:
            raise RuntimeError("stopped half-way")
        done.extend(ks)
        return df.withColumn("twice", F.col("id") * 2)

    stream = lambda: spark.readStream.schema("id int, k int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    with pytest.raises(Exception, match="half-way"):
        upkeep.backfill(stream(), lambda df: derive(df, True), out, check).awaitTermination(60)
    assert len(done) == 2
    upkeep.backfill(stream(), derive, out, check).awaitTermination(60)
    assert sorted(done) == [0, 1, 2, 3]
    like = spark.createDataFrame([], "id int, k int, twice int")
    rows = upkeep.read_backfill(like, out, "id").collect()
    assert sorted((r["id"], r["twice"]) for r in rows) == [(k * 10 + i, 2 * (k * 10 + i)) for k in range(4) for i in range(5)]
    upkeep.backfill(stream(), derive, out, check).awaitTermination(60)
    assert len(done) == 4


def test_intent_gate(spark):
    """No intent, an inferred type and too few eligible rows leave a list as it is; rows without a type stay."""
    from quillon.operators import ranking

    ranked = spark.createDataFrame([(q, i, ["dress", "top", None, "dress", "skirt"][i % 5], ["mini", "tee", None, "maxi", None][i % 5], i + 1) for q in range(6) for i in range(10)], "q int, id int, category string, subcategory string, rank int")
    requests = [(0, "a red dress", "dress", None), (1, "something nice", "dress", None), (2, "a dress", None, None), (3, "shorter than a minidress", None, "mini"), (4, "Gowns please", "dress", "mini"), (5, None, "dress", None)]
    asked = spark.createDataFrame(requests, "q int, text string, want_category string, want_subcategory string")
    got = {}
    for r in ranking.intent_gate(ranked, asked, "q", {"dress": ("dress", "gowns")}, 5).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got[0] == [0, 2, 3, 5, 7, 8] == got[4] and all(got[q] == list(range(10)) for q in (1, 2, 3, 5))
    assert ranking.intent_gate(ranked, asked, "q", {"dress": ("dress",)}, 7).where("q = 0").count() == 10
