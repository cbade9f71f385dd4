"""Golden and metamorphic cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays, text
from quillon.operators import maintenance, material, preferences, ranking, retrieval
from quillon.plans.registry import QUERIES
from quillon.sources import readers
from quillon.streaming import limits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.slugify(F.lit("  Red -- Ring! "))) == "red-ring"
    assert one(spark, text.price_cents(F.lit("$1,234.50"))) == 123450
    assert one(spark, text.html_text(F.lit("<p>a&amp;lt;b</p><script>x</script> &nbsp;c"))) == "a&lt;b c"
    assert one(spark, text.height_cm(F.lit("5'9\""))) == 175
    assert one(spark, text.height_cm(F.lit("5'8\" / 173 cm"))) == 173
    assert one(spark, text.height_cm(F.lit("900 cm"))) is None
    assert one(spark, text.size_label(F.lit("2xl"))) == "2XL" and one(spark, text.size_label(F.lit("sku 1"))) is None
    assert one(spark, text.truncate_words(F.lit("ab cd ef"), 5)) == "ab cd"
    assert one(spark, text.truncate_words(F.lit("abcdef"), 3)) == "abc"
    assert [one(spark, text.s_stem(F.lit(w))) for w in ("queries", "boxes", "dress", "rings", "class")] == ["query", "boxe", "dress", "ring", "class"]
    assert not one(spark, F.lit("minimalist").rlike(text.whole_words(["mini"]))) and one(spark, F.lit("rings").rlike(text.whole_words(["ring"], True)))
    assert one(spark, text.canonical_url(F.lit("HTTP://A.com/x/?pid=3&u=1#z"), ("pid",))) == "https://a.com/x?pid=3"


def test_arrays(spark):
    assert one(spark, arrays.coerce_many(F.array(F.lit("Red "), F.lit("no"), F.lit("dark_blue"), F.lit("red")), ["red", "dark-blue"])) == ["red", "dark-blue"]
    assert one(spark, arrays.expand(F.array(F.lit("a"), F.lit("x-y")), {"a": ("a", "b")})) == ["a", "b", "x y"]


def test_elo(spark):
    log = spark.createDataFrame([(1, i, w) for i, w in enumerate((True, False, True))], "u int, ts int, won boolean")
    assert abs(preferences.elo_replay(log, ["u"], ["ts"], "won").first()["score"] - 0.5455) < 1e-12
    pairs = spark.createDataFrame([("a", "a"), ("a", None), ("b", "c")], "w string, l string")
    assert sorted((r["key"], r["won"]) for r in preferences.comparisons_to_sides(pairs, "w", "l").collect()) == [("a", True), ("b", True), ("c", False)]


def test_ranking(spark):
    df = spark.createDataFrame([(i, "x" if i < 8 else "y") for i in range(10)], "id int, g string").withColumn("rank", F.col("id") + 1)
    capped = [r["id"] for r in ranking.diversity_cap(df, "g", 5, 0.4).orderBy("place").collect()]
    assert capped == [0, 1, 8, 9, 2]
    assert [r["id"] for r in ranking.diversity_cap(df, "g", 10).orderBy("place").collect()] == list(range(10))
    assert ranking.type_gate(df.withColumn("q", F.lit(1)), "q", F.col("g") == "y").count() == 10  # too few survivors
    assert ranking.page_numbers(5, 20) == [1, None, 4, 5, 6, None, 20]


def test_pick_pair(spark, tmp_path):
    for name, brands, want in (("late", ["a"] * 60 + ["b"], (0, 60)), ("same", ["a"] * 5, (0, 1))):
        spark.createDataFrame(list(enumerate(brands)), "p_partkey long, p_brand string").write.parquet(str(tmp_path / name / "part.parquet"))
        assert tuple(QUERIES["pick_pair"](spark, str(tmp_path / name)).first()) == want


def test_arguments():
    assert (retrieval.clamp_limit(None), retrieval.clamp_limit(0), retrieval.clamp_limit(9999)) == (120, 1, 500)
    with pytest.raises(ValueError):
        retrieval.check_boost(float("nan"))


def test_limits(spark):
    assert limits.admit([0, 1, 2, 60.5, 60.6], 2, 60) == ([True, True, False, True, False], [1, 60.5])
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, t + dt.timedelta(seconds=i), i < 3) for i in range(5)]
    got = limits.breaker(spark.createDataFrame(rows, "k int, i int, ts timestamp, bad boolean"), "k", "ts", "i", "bad").first()
    assert (got["trips"], got["refused"]) == (1, 2)
    ev = spark.createDataFrame([(1, i, t + dt.timedelta(seconds=10 * i)) for i in range(12)], "k int, i int, ts timestamp")
    assert limits.rate_limit(ev, "k", "ts", "i", 3, 60).where("admitted").count() == 6
    assert limits.fixed_window(ev, "k", "ts", "i", 3, 60).first()["admitted"] == 6


def test_one_long_log(spark):
    """A key with most rows is cut over tasks and gives what one pass gives."""
    draw, t = random.Random(5), dt.datetime(2024, 1, 1)
    rows, at = [], 0
    for i in range(6000):
        at += draw.choice([1, 2, 9, 40])
        rows.append((None if i % 50 == 0 else 2**60 + i // 10 % 2 if i % 10 == 0 else 7, i, t + dt.timedelta(seconds=at), draw.random() < 0.5))
    df = spark.createDataFrame(rows, "k long, i int, ts timestamp, bad boolean").repartition(5)
    elo, ok, win, cut = {}, {}, {}, {}
    for k, i, x, bad in rows:
        s, n = elo.get(k, (0.5, 0))
        elo[k] = (s + 0.1 * (1 - s) if bad else s - 0.1 * s, n + 1)
        x = (x - t).total_seconds()
        start, n, hits, good = win.get(k, (-1e9, 0, 0, 0))
        start, n = (x, 1) if x - start >= 60 else (start, n + 1)
        win[k] = (start, n, hits + 1, good + (n <= 3))
        run, until, trips, no = cut.get(k, (0, -1e9, 0, 0))
        shut = x < until
        run = run if shut else run + 1 if bad else 0
        trip = not shut and bad and run >= 3
        cut[k] = (run, x + 30 if trip else until, trips + trip, no + shut)
        if k is not None:
            ok.setdefault(k, []).append((i, x))
    got = {r["k"]: (r["score"], r["n"]) for r in preferences.elo_replay(df, ["k"], ["ts", "i"], "bad").collect()}
    assert got.keys() == elo.keys() and all(abs(got[k][0] - elo[k][0]) < 1e-12 and got[k][1] == elo[k][1] for k in elo)
    assert {r["k"]: (r["hits"], r["admitted"]) for r in limits.fixed_window(df, "k", "ts", "i", 3, 60).collect()} == {k: x[2:] for k, x in win.items()}
    assert {r["k"]: (r["trips"], r["refused"]) for r in limits.breaker(df, "k", "ts", "i", "bad").collect()} == {k: x[2:] for k, x in cut.items()}
    want = {i: a for x in ok.values() for (i, _), a in zip(x, limits.admit([s for _, s in x], 3, 60)[0])}
    limited = limits.rate_limit(df.where("k is not null"), "k", "ts", "i", 3, 60).withColumn("task", F.spark_partition_id()).collect()
    assert {r["i"]: r["admitted"] for r in limited} == want
    assert len({r["task"] for r in limited if r["k"] == 7}) > 1


def test_upsert_is_idempotent(spark):
    e = spark.createDataFrame([(1, "a", "h1", 5), (2, "b", "h2", 5)], "k int, v string, content_hash string, seen int")
    i = spark.createDataFrame([(2, "c", "h3", 4), (3, "d", "h4", 9)], "k int, v string, content_hash string, seen int")
    new = maintenance.upsert(e, i, "k", [], "seen")
    assert sorted(map(tuple, new.collect())) == [(1, "a", "h1", 5), (2, "c", "h3", 5), (3, "d", "h4", 9)]
    again = maintenance.classify(new, i, "k")
    assert {r["status"] for r in again.collect()} == {"absent", "unchanged"}


def test_run_source(spark, tmp_path):
    row = {"brand": "acme", "name": "n", "product_url": "u", "price_cents": 3}
    (tmp_path / "acme_products.json").write_text(json.dumps([row, row | {"name": "m"}]))
    assert readers.read_run(spark, str(tmp_path)).count() == 2
    (tmp_path / "acme_products.json").write_text(json.dumps([row | {"brand": "other"}]))
    with pytest.raises(Exception, match="bad row"):
        readers.read_run(spark, str(tmp_path)).select("brand").collect()


def test_stream(spark, tmp_path, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    schema.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema.schema).parquet(str(tmp_path / "in"))
    q = limits.streaming_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(count) as n from hits").first()["n"] == schema.count()


def test_elo_dimensions(spark):
    """Against a plain fold: equal keys say nothing, a missing side leaves the other, all step sizes in one pass, slices of time or none."""
    import random

    r = random.Random(8)
    rows = [(r.choice("uv"), r.choice([i, i // 7, None]), i, *(r.choice([None, "", "a", "b", "c"]) for _ in range(4))) for i in range(700)]
    log = spark.createDataFrame(rows, "u string, ts int, i int, wb string, lb string, wf string, lf string").repartition(5)
    want = {}
    for u, _, _, wb, lb, wf, lf in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        for name, w, l in (("brand", wb or None, lb or None), ("fiber", wf or None, lf or None)):
            for own, other, won in ((w, l, 1), (l, w, 0)):
                if own and own != other:
                    s, n = want.get((u, name, own), ((0.5, 0.5), 0))
                    want[u, name, own] = tuple(x + k * (won - x) for x, k in zip(s, (0.1, 0.4))), n + 1
    got = preferences.elo_dimensions(log, ["u"], ["ts", "i"], {"brand": ("wb", "lb"), "fiber": ("wf", "lf")}, [0.1, 0.4]).collect()
    assert len(got) == len(want)
    for x in got:
        s, n = want[x["u"], x["dimension"], x["key"]]
        assert x["n"] == n and all(abs(a - b) < 1e-12 for a, b in zip(s, x["scores"]))


def test_rules(spark):
    """An attribute with several preferred values is one hit; conditions; guidance."""
    items = spark.createDataFrame([(1, "cut", "a"), (1, "cut", "b"), (1, "hem", "x"), (2, "cut", "z"), (2, "hem", None)], "id int, attr string, value string")
    rules = spark.createDataFrame([(1, "cut", ["a", "b"], ["x"], "one", {}), (1, "hem", [], ["x"], "one", {}), (2, "hem", ["x"], None, "two", {"body": "tall"})], "place int, attr string, prefers array<string>, avoids array<string>, reason string, when map<string, string>")
    assert {(r["id"], r["rule"]): (r["h"], r["m"]) for r in preferences.rule_hits(items, ["id"], rules.withColumnRenamed("place", "rule")).collect()} == {(1, 1): (1, 1), (1, 2): (1, 0), (2, 1): (0, 0), (2, 2): (0, 0)}
    assert {r["id"]: r["reason"] for r in preferences.best_reason(items, ["id"], rules.drop("when")).collect()} == {1: "two", 2: None}
    assert {r["id"]: r["reason"] for r in preferences.best_reason(items, ["id"], rules.drop("when"), least=2).collect()} == {1: None, 2: None}
    people = spark.createDataFrame([(1, {"body": "tall"}), (2, {"body": "short"}), (3, {})], "who int, context map<string, string>")
    scores = preferences.conditional_scores(items, ["id"], people, ["who"], rules.withColumnRenamed("place", "rule"))
    assert {(r["who"], r["id"]): r["score"] for r in scores.collect()} == {(1, 1): 0.75, (2, 1): 0.5, (3, 1): 0.5, (1, 2): 0.5, (2, 2): 0.5, (3, 2): 0.5}
    lines = spark.createDataFrame([([("why", list("abcdef"), list("uvwxy")), ("so", [], None)],)], "rules array<struct<reason: string, prefers: array<string>, avoids: array<string>>>")
    assert lines.select(preferences.guidance(F.col("rules"))).first()[0] == ["why — prefer: a, b, c, d, e — avoid: u, v, w, x", "so"]


def test_limit_stream(spark, sf_dir, tmp_path):
    """The stream admits what the batch fold admits, and keeps no state of keys that have been idle for a window."""
    from quillon.streaming import keyed

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    source, limit, seconds = str(tmp_path / "in"), 1, 43_200.0
    cuts = [r[0] for r in events.selectExpr("explode(percentile_approx(ts, array(0.25, 0.5, 0.75)))").collect()]
    for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None])):  # four files, in order of time
        part = events.where((F.col("ts") >= a) if a else F.lit(True)).where((F.col("ts") < b) if b else F.lit(True))
        part.coalesce(1).write.parquet(f"{source}/{k}")
    spark.createDataFrame([(-1, 1)], "event_id long, user_id long").selectExpr("event_id", "timestamp_ntz'2030-01-01 00:00:00' ts", "user_id").select(events.columns).coalesce(1).write.parquet(f"{source}/9")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    out = keyed.limit_stream(stream, "user_id", "ts", "event_id", limit, seconds)
    q = out.writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("limited").where("event_id >= 0").collect()
    want = {r["event_id"]: r["admitted"] for r in limits.rate_limit(events, "user_id", "ts", "event_id", limit, seconds).collect()}
    assert {r["event_id"]: r["admitted"] for r in rows} == want and not all(want.values())
    assert all((r["retry_after"] is None) == r["admitted"] and (r["admitted"] or 0 <= r["retry_after"] <= seconds) for r in rows)
    held = [x["stateOperators"][0]["numRowsTotal"] for x in q.recentProgress if x["stateOperators"]]
    assert max(held) > 10 and held[-1] <= 4  # the last hit came years later: all other keys were idle for a window and are forgotten
