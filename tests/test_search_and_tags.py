"""Pruned search against scoring every row, tagging on remarks, open categories against a loop."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.operators import categories, search, tagging


def plain_terms(text):
    words = [w for w in re.findall("[a-z0-9][a-z0-9]+", text.lower()) if w not in search.STOP_WORDS]
    return Counter([*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]])


def plain_rank(docs, asked, k):
    counted = {d: plain_terms(t) for d, t in docs}
    df = Counter(t for c in counted.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    vectors = {d: unit(c) for d, c in counted.items()}
    out = set()
    for q, t in asked:
        qv = unit(plain_terms(t))
        scored = [(-round(sum(x * v.get(t, 0.0) for t, x in qv.items()), 9), d) for d, v in vectors.items() if set(qv) & set(v)]
        out |= {(q, d, n + 1) for n, (_, d) in enumerate(sorted(scored)[:k])}
    return out


def test_pruned_ranks_equal_all_rows_and_blocks_are_left_out(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, draw(rng.randrange(5, 60))) for i in range(500)] + [(1000, ""), (1001, None), (1002, "The the of"), (1003, "w0 w1 w1"), (1004, "w0 w1 w1")]
    asked = [(i, draw(4) + " zzz") for i in range(20)] + [(90, "w0"), (91, "nothing known"), (92, "")]
    index = search.index(spark.createDataFrame(docs, "d long, t string"), "d", F.col("t"))
    blocks = search.block_table(index)
    terms = search.query_terms(spark.createDataFrame(asked, "q long, t string"), "q", F.col("t"), blocks)
    got = {(r["query"], r["key"], r["rank"]) for r in search.rank(index, blocks, terms, 5).collect()}
    assert got == plain_rank([(d, t or "") for d, t in docs], asked, 5)
    wanted = search.wanted_blocks(terms, blocks, 5).join(blocks, ["term", "block"]).agg(F.sum("n")).first()[0]
    every = terms.join(blocks, "term").agg(F.sum("n")).first()[0]
    assert wanted < 0.5 * every


def test_an_index_of_asked_terms_has_the_weights_of_the_whole_and_ties_go_by_key(spark):
    docs = [(i, "w0 w1 w2 w2") for i in range(40)] + [(i, f"w0 w3 w{i}") for i in range(40, 60)] + [(60, "w7"), (60, "w7 w8"), (61, None)]
    asked = [(1, "w1 w2"), (2, "w3 w8"), (3, "zzz")]
    rows, queries = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(asked, "q long, t string")
    told = lambda df: {(r["key"], r["term"], round(r["weight"], 12), round(r["idf"], 12), r["block"]) for r in df.collect()}
    whole, part = search.index(rows, "d", F.col("t")), search.index(rows, "d", F.col("t"), (queries, F.col("t")))
    assert told(part) == {r for r in told(whole) if r[1] in {"w1", "w2", "w1 w2", "w3", "w8"}}
    blocks = search.block_table(part)
    found = search.rank(part, blocks, search.query_terms(queries, "q", F.col("t"), blocks), 7).collect()
    assert sorted((r["rank"], r["key"]) for r in found if r["query"] == 1) == [(n + 1, n) for n in range(7)]
    assert {r["key"] for r in found if r["query"] == 2} == {60, *range(40, 46)}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Land acquisition of 91.58 % completed. Work is slow.", {("land", "acquisition", None, False)}),
        ("96% land acquisition done", {("land", "acquisition", None, True)}),
        ("Stage - I forest clearance obtained from the Forest Department.", {("forest", "clearance", "forest department", True)}),
        ("FC is awaited; fc of the pump was fine", {("forest", "clearance", None, False)}),
        ("Railway approval received without delay; a strike went on.", {("approval", "railway", "railways", True), ("law and order", "agitation", None, False)}),
        ("Shifting of electric lines pending.", {("utilities", "shifting", None, False)}),
        ("NOC granted. The Noc is fine.", {("approval", "no objection", None, True)}),
        ("The contractor has been very slow and heavy rains came", {("contractor", "performance", None, False), ("weather", "rain", None, False)}),
        ("All is well.", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_remarks(spark, text, expected):
    rows = tagging.tag_texts(spark.createDataFrame([(1, text)], "id long, remark string"), ["id"], "remark", tagging.REMARKS).collect()
    assert {(r["category"], r["subtype"], r["authority"], r["resolved"]) for r in rows} == expected


def test_the_shortest_sentence_stands_for_a_category(spark):
    text = "The court in the capital has stayed the award. Court case. The high court sat! Arbitration went on in the city."
    (r,) = tagging.tag_texts(spark.createDataFrame([(1, text)], "id long, t string"), ["id"], "t", tagging.REMARKS).collect()
    assert (r["sentence"], r["subtype"], r["n"]) == ("Court case.", "court", 4)
    rows = tagging.tag_sentences(spark.createDataFrame([(1, text)], "id long, t string"), ["id"], "t", tagging.REMARKS).collect()
    assert [r["subtype"] for r in sorted(rows, key=lambda r: r["place"])] == ["court", "court", "court", "arbitration"]


def test_open_categories_equal_a_loop(spark):
    rng = random.Random(4)
    cats = ["a", "b"]
    rows = sorted({(k, rng.randrange(30)) for k in range(5) for _ in range(14)})
    observed = sorted({(k, t) for k, t in rows if rng.random() < 0.7} | {(0, 99), (7, 1)})
    mentions = sorted({(k, t, rng.choice(cats)) for k, t in observed if rng.random() < 0.5} | {(1, 200, "a")})
    mentions = [(*m, rng.choice([True, False, None])) for m in mentions]
    got = categories.open_block(
        spark.createDataFrame(rows, "k int, t int"), spark.createDataFrame(observed, "k int, t int"), spark.createDataFrame(mentions, "k int, t int, category string, resolved boolean"), "k", "t", cats, 3, 8
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [t for k, t in observed if k == r["k"] and t <= r["t"]]
        assert r["n_observed"] == len(seen)
        total = 0
        for c in cats:
            own = sorted((t, bool(done)) for k, t, cat, done in mentions if (k, cat) == (r["k"], c) and t <= r["t"])
            assert r[f"ever_{c}"] == bool(own) and r[f"since_{c}"] == (r["t"] - own[0][0] if own else None)
            is_open = bool(own) and sum(t <= own[-1][0] for t in seen) >= len(seen) - 2 and not own[-1][1] and r["t"] - own[-1][0] < 8
            assert r[f"open_{c}"] == is_open
            total += is_open
        assert r["open_total"] == total
