"""Links, search strings, bundles, summaries, pulls, rewording, dated facts and global order against plain Python."""

import datetime
import math
import random
import re

from pyspark.sql import functions as F

from panelwright.functions import rules as R
from panelwright.operators import aggregates, linking, ordering, records, relational, summaries

RULES = linking.Rules(most_df=2, code=r"(?i)road\s*(\d+)", code_prefix="r", objects=("bypass", "bridge", "road"), generic=("road",), dropped=("outer", "bypass", "bridge", "road"))
NAMES = [
    (1, "Construction of Kelmar to Dorvik outer bypass Road 17", "Northland", "ABC"),
    (2, "Construction of bridge at Kelmar", "Southland", None),
    (3, "Widening of Road 5 Fenwick Northland", "Northland", "Xy"),
    (4, None, None, None),
    (5, "Construction", "All", "ABC"),
]


def known(spark):
    df = spark.createDataFrame(NAMES, "id long, name string, state string, short string")
    return linking.profiles(df, "id", "name", "state", "short", RULES)


def test_profiles_keep_distinctive_words_only(spark):
    got = {r["entity"]: (r["places"], r["codes"], r["object"]) for r in known(spark).collect()}
    assert got[1] == (["kelmar", "dorvik"], ["code:r17"], "bypass") and got[2] == (["kelmar"], [], "bridge")
    assert got[3] == (["widening", "fenwick"], ["code:r5"], "road")
    assert got[4] == ([], [], None) and got[5][0] == []


def test_links_need_two_words_or_an_anchor(spark):
    texts = [
        (1, "Work on the Dorvik BYPASS near Kelmar has stopped"),  # both words and the object
        (2, "Kelmar news"),  # one word of two entities, no anchor
        (3, "Fenwick hears of Road 5"),  # one word and the code
        (4, None),
        (5, ""),
        (6, "Kelmar, bridge and bypass"),  # both of the entities, alike
        (7, "Dorvik, says abc"),  # the short name counts as it is spelt
        (8, "Dorvik, says ABC"),
        (8, "Dorvik, says ABC"),  # a repeated row
        (None, "Dorvik and Kelmar"),
    ]
    out = linking.link(spark.createDataFrame(texts, "k long, t string"), "k", "t", known(spark), RULES).collect()
    got = {r["k"]: (r["entity"], r["score"], r["outcome"]) for r in out}
    assert len(out) == len(got) == 9
    assert got[1] == (1, 1.0, "linked")
    assert got[2] == (None, 0.25, "none")
    assert got[3] == (3, 0.75, "linked")
    assert got[4] == got[5] == (None, 0.0, "none")
    assert got[6] == (None, 0.75, "ambiguous")
    assert got[7][2] == "none" and got[8][0] == 1
    assert got[None][0] == 1


def test_no_texts_and_no_entities(spark):
    none = spark.createDataFrame([], "id long, name string, state string, short string")
    texts = spark.createDataFrame([(1, "Kelmar")], "k long, t string")
    assert [tuple(r) for r in linking.link(texts, "k", "t", linking.profiles(none, "id", "name", "state", "short", RULES), RULES).collect()] == [(1, None, 0.0, "none")]
    assert linking.link(texts.limit(0), "k", "t", known(spark), RULES).count() == 0


def test_search_strings_name_places_with_an_anchor(spark):
    got = {r["entity"]: r["a"] for r in known(spark).select("entity", linking.aliases(RULES.generic, ("All",), r"\d+").alias("a")).collect()}
    assert got[1] == ["Kelmar Dorvik bypass", "Kelmar Dorvik Northland", "R17 Kelmar", "ABC Kelmar Dorvik bypass"]
    assert got[2] == ["Kelmar bridge", "Construction of bridge at Kelmar", "Construction of bridge at Southland"]
    assert got[4] == [] and got[5] == ["Construction"]
    assert all(len(q) > 3 for qs in got.values() for q in qs) and all(len(qs) <= 5 and len(set(qs)) == len(qs) for qs in got.values())


def test_classified_takes_the_first_category(spark):
    df = spark.createDataFrame([("court stays land work",), ("land is late",), ("fine",), (None,)], "t string")
    out = df.select(linking.classified(F.col("t"), [("court", "court"), ("land", "land")], "stay", "late").alias("c")).select("c.*").collect()
    assert [tuple(r) for r in out] == [("court", 3), ("land", 2), (None, 1), (None, 1)]


def test_bundles_tell_every_part_of_every_key(spark):
    day = lambda d: datetime.datetime(2020, 1, d)
    master = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (3, None)], "k long, name string")
    seen = spark.createDataFrame([(1, day(1), 5), (1, day(3), 6), (9, day(2), 7), (None, day(2), 8), (2, day(30), 9)], "k long, d timestamp, v int")
    aliases = spark.createDataFrame([(9, 1)], "alias long, key long")
    parts = [records.Part("master", master, "k", None, (F.col("name"),)), records.Part("seen", seen, "k", F.col("d"), (F.col("v"),)), records.Part("gone", None, "k", None)]
    asof = F.lit("2020-01-15").cast("timestamp")
    rows = records.bundle(parts, aliases, asof)
    got = sorted((r["part"], r["key"], r["row"]) for r in rows.collect())
    assert got == sorted([("master", 1, '{"name":"a"}'), ("master", 2, '{"name":"b"}'), ("master", 3, '{"name":null}'), ("master", 3, '{"name":null}'), ("seen", 1, '{"v":5}'), ("seen", 1, '{"v":6}'), ("seen", 1, '{"v":7}')])
    head = {(r["key"], r["part"]): (r["present"], r["n"], r["latest"]) for r in records.heads(rows, master.select("k"), parts).collect()}
    assert len(head) == 9
    assert head[1, "seen"] == (True, 3, '{"v":6}') and head[2, "seen"] == (True, 0, None) and head[3, "master"] == (True, 2, '{"name":null}') and head[1, "gone"] == (False, 0, None)
    assert records.bundle(parts, aliases, asof, spark.createDataFrame([(2,)], "x long")).count() == 1


def test_summaries_count_each_scope_and_all(spark):
    rows = [("n", 1, 2, 1, True, 10.0), ("n", 2, 0, 0, False, 20.0), ("s", 3, 1, None, None, None), (None, 4, 1, 2, True, 7.0)]
    facts = spark.createDataFrame(rows, "scope string, k long, n_open int, n_overdue int, silent boolean, amount double")
    got = {r["scope"]: tuple(r)[1:] for r in summaries.linked(facts, "scope", "amount").collect()}
    assert got == {"all": (4, 3, 2, 2, 17.0), "n": (2, 1, 1, 1, 10.0), "s": (1, 1, 0, 0, 0.0)}
    assert {(r["scope"], r["k"], r["place"]) for r in summaries.overdue(facts, "scope", "k", "amount", 1).collect()} == {("all", 1, 1), ("n", 1, 1)}
    links = spark.createDataFrame([("n", "x", True), ("n", "x", False), ("n", "x", None), ("n", "y", None)], "scope string, m string, ok boolean")
    by = {(r["scope"], r["m"]): tuple(r)[2:] for r in summaries.coverage(links, "scope", "m", F.col("ok")).collect()}
    z, p, n = 1.96, 0.5, 2
    c = (p + z * z / (2 * n)) / (1 + z * z / n)
    h = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert by["n", "x"] == (3, 2, 1, round(c - h, 3), round(c + h, 3)) and by["all", "y"] == (1, 0, 0, None, None)


def test_the_newest_pull_replaces_a_group_whole(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("a", 2, "old"), ("b", 1, "old"), ("b", 1, "older"), (None, 1, "old")], "g string, k int, v string")
    pulls = spark.createDataFrame([("a", 3, "p1", 1), ("a", 1, "p2", 2), ("a", 1, "p2b", 2), (None, 1, "p2", 2)], "g string, k int, v string, pull int")
    out = {(r["g"], r["k"]): r["v"] for r in relational.newest_pull(base, pulls, "g", "pull", ["g", "k"], ["v"]).collect()}
    assert out == {("a", 1): "p2", ("b", 1): "old", (None, 1): "p2"}
    same = relational.newest_pull(base, pulls.limit(0), "g", "pull", ["g", "k"], ["v"]).collect()
    assert len(same) == 4


def test_numbers_become_words_by_band(spark):
    bands = ((0.3, "low"), (0.7, "even"))
    texts = ["P = 0.12 and P = 0.9 (score 4.2)", "0.5", "P = 0.5", "", None, "P = 0.3P = 0.69"]
    policy = [(r"P = ([0-9.]+[0-9])", lambda x: F.concat(F.lit("rated "), R.banded(x.cast("double"), bands, "high"))), (r"(rated)", lambda x: F.upper(x))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.reworded(F.col("t"), policy, (r" ?\(score [0-9.]+\)",))).collect()]

    def brute(t):
        word = lambda v: "low" if v < 0.3 else "even" if v < 0.7 else "high"
        t = re.sub(r"P = ([0-9.]+[0-9])", lambda m: "rated " + word(float(m[1])), t)
        return re.sub(r" ?\(score [0-9.]+\)", "", t.replace("rated", "RATED"))

    assert got == [None if t is None else brute(t) for t in texts]


def test_a_plan_is_not_an_event(spark):
    day = datetime.date
    rows = [(day(2020, 5, 2), "2020-04"), (day(2020, 5, 2), "2020-06"), (day(2020, 5, 2), "soon"), (None, "2019"), (None, None), (day(2018, 1, 1), None)]
    df = spark.createDataFrame(rows, "p date, e string").select(R.dated_fact(F.col("p"), F.col("e"), F.lit("2020-06-30").cast("date"), 18).alias("f")).select("f.*")
    assert [tuple(r) for r in df.collect()] == [
        (day(2020, 4, 1), "month", False, True), (None, None, True, True), (None, None, True, True),
        (day(2019, 1, 1), "year", False, True), (None, None, False, False), (None, None, True, False),
    ]


def test_running_sums_carry_over_ranges(spark):
    draw = random.Random(2)
    rows = [(i, draw.randrange(40), draw.choice([None, 1, 2, -3])) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a int, v int").repartition(5)
    ranged = ordering.in_ranges(df, "a", "i")
    out = ordering.running(ranged, ["a", "i"], {"place": F.lit(1), "total": F.col("v")}, {"top": F.col("v")}).collect()
    total, top = 0, None
    want = {}
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        if v is not None:
            total, top = total + v, v if top is None else max(top, v)
        want[i] = (n, total, top)
    assert {r["i"]: (r["place"], r["total"], r["top"]) for r in out} == want
    assert ordering.numbered(ordering.in_ranges(df.limit(0), "a"), ["a"]).count() == 0


def test_holm_and_weighted_precision_in_ranges(spark):
    draw = random.Random(4)
    ps = [(i, round(draw.random(), 2)) for i in range(60)]
    got = {r["k"]: r["p_holm"] for r in aggregates.holm(spark.createDataFrame(ps, "k long, p double"), "p", "k").collect()}
    most = 0.0
    for n, (k, p) in enumerate(sorted(ps, key=lambda r: (r[1], r[0]))):
        most = max(most, p * (len(ps) - n))
        assert abs(got[k] - min(1.0, most)) < 1e-12
    rows = [(draw.randrange(9) / 8, draw.random() < 0.4, float(draw.randrange(1, 5))) for _ in range(200)] + [(None, True, 3.0)]
    ap = aggregates.weighted_precision(spark.createDataFrame(rows, "s double, y boolean, w double"), "s", F.col("y"), F.col("w")).first()[0]
    up = n = total = 0.0
    for s in sorted({r[0] for r in rows if r[0] is not None}, reverse=True):
        p = sum(w for t, y, w in rows if t == s and y)
        up, n = up + p, n + sum(w for t, _, w in rows if t == s)
        total += p * up / n
    assert abs(ap - total / up) < 1e-12
