"""Small rules of the catalog and the checks that stop a query."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog as c


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def texts(*values):
    return F.array(*(F.lit(v) for v in values))


def test_guards(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert c.require_known(rows, "k", spark.range(5), "id").count() == 3 and c.require_unique(rows, "k").count() == 3
    with pytest.raises(Exception, match="k is unknown"):
        c.require_known(rows, "k", spark.range(2), "id").collect()
    with pytest.raises(Exception, match="v is not unique"):
        c.require_unique(rows.union(rows.where("k = 1")), "v").collect()
    table = spark.createDataFrame([(1, 7, True), (2, 7, True)], "k int, days int, enabled boolean")
    patch = lambda *x: spark.createDataFrame(x, "k int, days int, enabled boolean")
    assert sorted(map(tuple, c.patched(table, patch((2, 3, None)), "k", ["days", "enabled"]).collect())) == [(1, 7, True), (2, 3, True)]
    for bad in (patch((9, 3, None)), patch((2, 3, None), (2, 4, None))):
        with pytest.raises(Exception, match="k is"):
            c.patched(table, bad, "k", ["days", "enabled"]).collect()


def test_rules(spark):
    assert one(spark, c.tag_value(texts("x", " Category: Tops ", "CATEGORY: Pants: wide"), "category")) == "pants: wide"
    assert one(spark, c.tag_value(texts("x"), "category")) is None
    assert [one(spark, c.for_women(texts(*t))) for t in (["Female", "male"], ["unisex"], ["Unisex", "MALE"], ["x"])] == [True, True, False, False]
    assert [one(spark, c.is_garment(texts(*t), F.lit(n), ["bags"], "(?i)sock")) for t, n in ((["category:bags"], "shirt"), (["category:tops"], "sock"), (["x"], "Socks"), (["x"], "shirt"))] == [False, True, False, True]
    sizes = ["xs", "2xl", "28x32", "one size", "002", " m ", "S", "s", "SKU-1", "BLK01", "", None, "XXXL", "4XL", "5XL", "1234"]
    assert one(spark, c.size_values(texts(*sizes))) == ["XS", "2XL", "28X32", "ONE SIZE", "002", "M", "S", "XXXL", "4XL"]
    badge = lambda clean, primary: one(spark, c.material_badge(F.lit(clean).cast("string"), F.lit(primary).cast("string")))
    assert [badge("95% cotton, 5% x", "cotton"), badge("a very long part of a composition, x", "wool"), badge(None, "wool"), badge(" , x", "wool")] == ["95% cotton", "wool", None, None]
    assert one(spark, c.similar_query(texts("mini-dress", "a-line", "v-neck", "short", "mini"), F.lit("100% silk"))) == "mini dress a line v neck short 100% silk"
    assert one(spark, c.outbound(F.lit("u?a=1"), "s")) == "u?a=1&utm_source=s&utm_medium=referral"
    forms = {"t-shirt": ("tee", "t shirt"), "warm": ("cozy", "warm")}
    assert one(spark, c.lexical_forms(F.lit("Cozy T shirt"), forms)) == ["tee", "t shirt", "cozy", "warm"] and one(spark, c.lexical_forms(F.lit("Cozy T shirt"), forms, 3)) == ["tee", "t shirt", "cozy"]
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert one(spark, c.due(F.lit(True), F.lit("2024-01-03 11:00:00").cast("timestamp"), F.expr("interval 7 days"), now)) is True
    assert one(spark, c.due(F.lit(True), F.lit("2024-01-03 13:00:00").cast("timestamp"), F.expr("interval 7 days"), now)) is False
    assert one(spark, c.due(F.lit(True), F.lit(None).cast("timestamp"), F.expr("interval 7 days"), now)) is True and one(spark, c.due(F.lit(None).cast("boolean"), now, F.expr("interval 7 days"), now)) is False
    assert [one(spark, c.lapsed(F.lit("2024-01-01").cast("timestamp"), F.lit(d).cast("int"), now)) for d in (None, 3, 4, 5)] == [True, True, True, False]
    s = lambda v, at, m, h: one(spark, c.stale(F.lit(v).cast("int"), 2, F.lit(at).cast("string"), F.lit(m).cast("string"), "a", F.lit(h).cast("string"), F.lit("h")))
    assert [s(2, "t", "a", "h"), s(1, "t", "a", "h"), s(2, None, "a", "h"), s(2, "t", None, "h"), s(2, "t", "b", "h"), s(2, "t", "a", "x"), s(None, "t", "a", "h")] == [False] + [True] * 6
    assert [one(spark, c.upstream_relevance(F.lit(i), F.lit(n))) for i, n in ((0, 0), (0, 4), (3, 4))] == [1.0, 1.0, 0.25]


def test_soft_delete_by_cadence(spark):
    """A row with a long cadence is kept longer; a run that saw too few of a group deletes none of it."""
    from quillon.operators import maintenance

    rows = [(1, "a", "2024-01-01", 3), (2, "a", "2024-01-01", 9), (3, "a", "2024-01-15", 3), (4, "a", "2024-01-01", None), (5, "b", "2024-01-01", 1), (6, "b", "2024-01-01", 1), (7, "b", "2024-01-01", 1)]
    existing = spark.createDataFrame(rows, "k int, g string, s string, c int").withColumn("s", F.col("s").cast("timestamp_ntz"))
    incoming = spark.createDataFrame([(3,), (8,), (7,)], "k int")
    run = lambda **kw: {r["k"] for r in maintenance.soft_delete(existing, incoming, "k", "g", "s", "2024-01-16 00:00:00", **kw).where("deactivate").collect()}
    assert run(share=0.25, cadence="c") == {1, 4, 5, 6} and run(share=0.25) == {1, 2, 4, 5, 6} and run(share=0.3, cadence="c") == {5, 6}
