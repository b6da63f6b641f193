import pytest
from pyspark.sql import functions as F

from panelwright.functions import dates, scalars, text
from panelwright.operators import aggregates, entity, models, quality, relational, retrieval, serving, temporal


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "out"), [("2020", ("2020-01-01", "year")), ("2020-05", ("2020-05-01", "month")), ("2020-05-07", ("2020-05-07", "day")), ("x", None), ("2020-13", None)])
def test_partial_dates(spark, raw, out):
    v = value(spark, dates.partial_date(F.lit(raw)))
    assert (v and (str(v["date"]), v["precision"])) == out


@pytest.mark.parametrize(("raw", "out"), [("07/2015", "2015-07-01"), ("Jul-15", "2015-07-01"), ("2015-7", "2015-07-01"), ("soon", None)])
def test_loose_months(spark, raw, out):
    v = value(spark, dates.loose_month(F.lit(raw)))
    assert (v and str(v)) == out


@pytest.mark.parametrize(("raw", "out"), [("1,23,456.5", 123456.5), ("(12)", -12.0), ("", None), ("n.a.", None)])
def test_numbers(spark, raw, out):
    assert value(spark, scalars.parse_number(F.lit(raw))) == out


def test_three_values(spark):
    null = F.lit(None).cast("boolean")
    assert value(spark, scalars.either_known(null, F.lit(True))) is None
    assert value(spark, scalars.three_state(null, null)) == "unknown"
    assert value(spark, scalars.three_state(F.lit(True), F.lit(True))) == "flagged"


def test_tokens_and_ratios(spark):
    assert value(spark, scalars.union_tokens(F.lit("a;b"), F.lit(None).cast("string"), F.lit("b;c"))) == "a;b;c"
    assert value(spark, scalars.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, scalars.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert value(spark, scalars.finite(F.lit(float("nan")))) is None
    assert value(spark, scalars.bin_right_open(F.lit(5), [0, 5, 10])) == 1


def test_text_rules(spark):
    assert value(spark, text.fuzzy_jaccard(F.array(F.lit("bridge"), F.lit("road")), F.array(F.lit("bridgE"), F.lit("road")))) == 1 / 3
    assert value(spark, text.typo_only(F.lit("phase 1 road"), F.lit("phase 2 road"))) is False
    assert value(spark, text.typo_only(F.lit("brigde"), F.lit("bridge"))) is True
    assert value(spark, text.bracketed_acronym(F.lit("Works (PWD) north"))) == "PWD"
    assert value(spark, text.scrub_emails(F.lit("to a.b@c.org now"))) == "to [email] now"
    assert value(spark, text.story_key(F.lit("Bridge: late again - The Paper"))) == "bridge late again"
    r = value(spark, text.km_range(F.lit("km 10+500 to km 12")))
    assert (r["lo"], r["hi"]) == (10.5, 12.0)


def test_shares_and_cues(spark):
    assert value(spark, text.share_done(F.lit("acquired 12.5 ha of 50 ha so far"))) == 0.25
    assert value(spark, text.share_done(F.lit("about 80 % done"))) == 0.8
    assert value(spark, text.share_done(F.lit("150% or nothing"))) is None
    states = [("applied", "applied|submitted"), ("granted", "granted|received")]
    assert value(spark, text.cue_state(F.lit("Forest clearance received after it was applied for"), "clearance", states)) == "granted"
    assert value(spark, text.cue_state(F.lit("nothing to report"), "clearance", states)) is None


def test_strict_and_inclusive_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 3, 2.0)], "k string, at int, v double")
    get = lambda inclusive: sorted((r["k"], r["t"], r["v"]) for r in temporal.asof_join(left, right, ["k"], "t", "at", ["v"], inclusive).collect() if r["v"])
    assert get(True) == [("a", 5, 1.0)] and get(False) == [("a", 5, 2.0)]


def test_features_do_not_see_the_future(spark):
    rows = spark.createDataFrame([(1, q, float(q * q % 7)) for q in range(12)], "k int, q int, x double")
    column = temporal.velocity(F.col("x"), ["k"], "q", 2, 1)
    whole = rows.withColumn("v", column).where("q <= 6")
    cut = temporal.until(rows, "q", F.lit(6)).withColumn("v", column)
    assert relational.same_rows(whole, cut)


def test_lookup_refuses_doubled_rows(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="rows share k"):
        relational.lookup(df, df.union(df), ["k"])


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    assert relational.digest(df).first() == relational.digest(df.repartition(7)).first()
    assert relational.digest(df).first() != relational.digest(df.limit(99)).first()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "u long, v long")
    assert {r["node"]: r["root"] for r in entity.components(edges).collect()} == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_resolution_keeps_differing_codes_apart(spark):
    rows = spark.createDataFrame([(1, "north river bridge", "A1", 10.0), (2, "north river bridge", "A1", 10.0), (3, "north river bridge", "B2", 10.0), (4, "unlike entirely", None, 5.0)], "id int, name string, code string, cost double")
    found = {r["id"]: r["verdict"] for r in entity.resolve(rows, "id", "name", "code", "cost").collect()}
    assert found == {1: "new", 2: "accepted", 3: "new", 4: "new"}


def test_dedupe_fills_from_the_others(spark):
    df = spark.createDataFrame([(1, 10, None, "x"), (1, 11, 5.0, None), (1, 12, 6.0, "y")], "k int, i int, a double, b string")
    row = quality.dedupe(df, ["k"], F.when(F.col("i") == 10, 0).otherwise(1), ["a", "b"], "i").first()
    assert (row["i"], row["a"], row["b"], row["n_rows"]) == (10, 6.0, "x", 3)


def test_average_precision_of_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "p double, y int")
    assert aggregates.average_precision(df, [], "p", "y").first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_bootstrap_is_repeatable(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("c"), (F.col("id") % 11).cast("double").alias("v"))
    a, b = (aggregates.interval(aggregates.bootstrap_means(d, "c", "v", 100, 3)).first() for d in (df, df.repartition(5)))
    assert a == b and a["lo"] < 5 < a["hi"]


def test_paging_is_whitelisted(spark):
    with pytest.raises(ValueError, match="sort must be one of"):
        serving.page(spark.range(3), {"id": F.col("id")}, "name; drop", "id", 1, 2)


def test_fusion_prefers_agreement(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query int, item int, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query int, item int, rank int")
    assert [r["item"] for r in retrieval.fuse([a, b], "item").orderBy("rank").collect()] == [2, 1, 3]


def test_promotion_rule():
    assert models.promote([(0.02, 0.001, 0.04)], 0.005, 0.05, 0.05)
    assert not models.promote([(0.02, -0.001, 0.04)], 0.005, 0.05, 0.05)
    assert not models.promote([(0.02, 0.001, 0.04)], 0.005, 0.07, 0.05)
