"""Stemmer, stored index and ranked search."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions.stem import english_stem, stemmed
from quillon.operators import index, search
from quillon.sources.tables import file_state

# Pairs of the stemmer's published vocabulary.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consolation consol consolations consol consolatory consolatori console consol consoles consol consolidate consolid consolidating consolid consolingly consol consols consol consonant conson consort consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspiring conspir constable constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeling kneel knees knee knell knell knightly knight knights knight
knitted knit knitting knit knives knive knocker knocker knockers knocker knocks knock generate generat generically generic communism communism arsenal arsenal hopping hop hoping hope hoped hope
luxuriated luxuri ties tie tied tie cries cri gas gas gaps gap kiwis kiwi this this cry cri by by say say easily easili dresses dress skies sky dying die news news inning inning proceed proceed""".split()


def test_published_stems(spark):
    want = dict(zip(PAIRS[::2], PAIRS[1::2]))
    assert {w: english_stem(w) for w in want} == want
    rows = spark.createDataFrame([(1, w) for w in want] + [(2, "knives")], "n int, term string")
    assert sorted(map(tuple, stemmed(rows).collect())) == sorted([(1, s) for s in want.values()] + [(2, "knive")])


WORDS = ["running", "runs", "run", "knives", "knife", "red", "the", "of", "blue"]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Null and empty texts, null filters, one word that every row has, repeated texts."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 9))) + " item", r.choice([None, "", "red knife"]), r.choice(["a", "b", "c", None]), r.choice([None, 5, 50, 500]), r.random() < 0.9) for i in range(400)]
    rows += [(1000, None, None, "a", 5, True), (1001, "the the the of the", "", "a", 5, None)]
    path = str(tmp_path_factory.mktemp("shop"))
    spark.createDataFrame(rows, "id long, title string, body string, brand string, price_cents int, active boolean").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def opened(shop, analyzer="none"):
    return index.open_index(shop, "id", {"title": F.col("title"), "body": F.col("body")}, ["brand", "price_cents", "active"], analyzer, 4)


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def test_index(spark, shop):
    got = opened(shop)
    want = {}
    for r in shop.collect():
        for field in ("title", "body"):
            at = collections.defaultdict(list)
            for i, w in enumerate(words(r[field])):
                at[w].append(i)
            want |= {(r["id"], field, w): (len(p), len(words(r[field])), p) for w, p in at.items()}
    rows = got.postings.select("id", "field", "term", "tf", "dl", "gaps", index.positions(F.col("gaps")).alias("at")).collect()
    assert {(r["id"], r["field"], r["term"]): (r["tf"], r["dl"], r["at"]) for r in rows} == want
    assert all(sum(r["gaps"]) == r["at"][-1] for r in rows)
    df = collections.Counter((f, w) for _, f, w in want)
    assert {(r["field"], r["term"]): r["df"] for r in got.terms.collect()} == df
    lengths = {(i, f): n for (i, f, _), (_, n, _) in want.items()}
    for r in got.fields.collect():
        own = [n for (_, f), n in lengths.items() if f == r["field"]]
        assert (r["n_docs"], r["tokens"]) == (len(own), sum(own)) and math.isclose(r["avgdl"], sum(own) / len(own))


def test_index_is_written_once(spark, shop, tmp_path):
    assert opened(shop) is opened(shop)
    path = str(tmp_path / "t")
    shop.limit(10).write.parquet(path)
    first = opened(spark.read.parquet(path))
    shop.limit(5).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    assert len(file_state(table)) == 2
    assert opened(table) is not first  # its files have changed


def test_no_exchange_of_postings(shop):
    """Scores are summed where a document's postings lie: the plan exchanges no postings."""
    idx = opened(shop)
    requests = shop.sparkSession.createDataFrame([(1, "red knife", None)], "q int, text string, expanded string")
    terms = search.weighted(idx, search.request_terms(requests, "q"), "q", {"title": 1.0})
    plan = search.parts(idx, terms, "q")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "PushedFilters" in plan


def test_phrase_and_conjunction(shop):
    idx = opened(shop)
    rows = {r["id"]: words(r["title"]) for r in shop.collect()}
    for terms in (["red", "the"], ["the", "the"], ["of"], ["run", "of", "the"]):
        n = {i: sum(w[k : k + len(terms)] == terms for k in range(len(w))) for i, w in rows.items()}
        assert {r["id"]: r["n"] for r in index.phrase(idx, terms, "title").collect()} == {i: k for i, k in n.items() if k}
        assert {r["id"] for r in index.conjunctive(idx, terms, "title").collect()} == {i for i, w in rows.items() if set(terms) <= set(w)}


REQUESTS = [
    (1, "red Knives", None, None, None, None, None), (2, "red running", "Red Running", ["a", "b"], None, None, None), (3, "red", "runs of", None, ["a", "c"], 10, None),
    (4, "blue the", " ", [], [], None, 50), (5, None, "knife", None, None, None, None), (6, "absent", "nothing", None, None, None, None), (7, "the the of item", "blue", None, ["b"], 5, 500),
]


def brute(rows, analyzer, boosts, k, floor):
    stem = english_stem if analyzer == "english" else (lambda w: w)
    docs = {(r["id"], f): [stem(w) for w in words(r[f])] for r in rows for f in boosts}
    docs = {x: w for x, w in docs.items() if w}
    out = []
    for q, text, expanded, brands, excluded, low, high in REQUESTS:
        weight = collections.Counter(map(stem, words(text)))
        if expanded and expanded.strip() and expanded.strip().lower() != (text or "").strip().lower():
            for w in words(expanded):
                weight[stem(w)] += 0.6
        found = collections.defaultdict(float)
        for f, boost in boosts.items():
            own = {i: w for (i, g), w in docs.items() if g == f}
            mean = sum(map(len, own.values())) / len(own)
            for t, w in weight.items():
                df = sum(t in x for x in own.values())
                for i, x in own.items():
                    if tf := x.count(t):
                        found[i] += boost * w * math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        by = {r["id"]: r for r in rows}
        ok = lambda r: r["active"] and (not brands or r["brand"] in brands) and (excluded is None or r["brand"] not in excluded) and (low is None or (r["price_cents"] or -1) >= low) and (high is None or r["price_cents"] is not None and r["price_cents"] <= high)
        best = sorted((-round(s, 6), i) for i, s in found.items() if ok(by[i]))[:k]
        out += [(q, i, n, -s) for n, (s, i) in enumerate(best, 1) if floor is None or -s >= floor]
    return out


@pytest.mark.parametrize("analyzer", ["none", "english"])
def test_search(spark, shop, analyzer):
    requests = spark.createDataFrame(REQUESTS, "q int, text string, expanded string, brands array<string>, exclude_brands array<string>, price_min int, price_max int")
    rows, boosts = shop.collect(), {"title": 4.0, "body": 1.5}
    for k, floor in ((10, None), (120, 2.0)):
        want = brute(rows, analyzer, boosts, k, floor)
        for prune in (True, False):
            got = [(r["q"], r["id"], r["rank"], r["score"]) for r in search.search(opened(shop, analyzer), requests, "q", boosts, k, floor, analyzer, prune).collect()]
            assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(want)]
            assert all(math.isclose(a[3], b[3], abs_tol=2e-6) for a, b in zip(sorted(got), sorted(want)))


def test_pruning_scores_less(spark, shop):
    """Documents whose terms cannot bring them among the best are not scored."""
    idx = opened(shop)
    requests = spark.createDataFrame([(1, "knives item", None)], "q int, text string, expanded string")
    terms = search.weighted(idx, search.request_terms(requests, "q"), "q", {"title": 1.0})
    everything = lambda of: of
    best = lambda some: search.parts(idx, some, "q").withColumnRenamed("part", "score").withColumn("rank", F.expr("row_number() over (partition by q order by score desc, id)")).where("rank <= 3")
    near = search.candidate_postings(idx, terms, "q", best, everything, 3).select("id").distinct().count()
    assert near < search.parts(idx, terms, "q").count() / 2


def test_sweep(spark):
    r = random.Random(2)
    parts = spark.createDataFrame([(q, d, f, r.random()) for q in range(3) for d in range(60) for f in ("x", "y") if r.random() < 0.8], "q int, d int, field string, part double")
    grid = {"x": [1.0, 4.0], "y": [0.5, 1.0, 3.0]}
    sums = collections.defaultdict(float)
    for row in parts.collect():
        for x in grid["x"]:
            for y in grid["y"]:
                sums[x, y, row["q"], row["d"]] += (x if row["field"] == "x" else y) * row["part"]
    want = set()
    for x in grid["x"]:
        for y in grid["y"]:
            for q in range(3):
                best = sorted((-round(s, 6), d) for (a, b, c, d), s in sums.items() if (a, b, c) == (x, y, q))[:5]
                want |= {(x, y, q, d, k) for k, (_, d) in enumerate(best, 1)}
    assert {(s["vector"]["x"], s["vector"]["y"], s["q"], s["d"], s["rank"]) for s in search.sweep(parts, "q", "d", grid, 5).collect()} == want
