"""What the fourth round's findings are about, on small rows."""

import math
import os
import random

from panelwright.operators import entity, experiments, identity, retrieval
from panelwright.plans import registry
from tests.test_graph import brute_components
from tests.test_identity import brute, found

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_a_run_takes_all_validation_cutoffs(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(experiments.Run, "fill", lambda self, variants, folds, *rest: asked.extend(folds))
    monkeypatch.setattr(experiments.Run, "compared", lambda self, champion, cluster, blocks: blocks)
    blocks = registry.QUERIES["ml_runs"](spark, SF)
    assert blocks == {"validation": [7998, 7999, 8000, 8001, 8002, 8003], "test": [8004]} and asked == sum(blocks.values(), [])


def test_the_first_links_of_a_home_are_taken_in_a_task(spark, monkeypatch):
    """Homes of more links than a task takes, and rounds that only fall to larger ones."""
    rng = random.Random(4)
    links = [(f"h{h} a{rng.randrange(25):02}", f"h{h} b{rng.randrange(25):02}", rng.randrange(500)) for h in range(3) for _ in range(60 + 60 * h)]
    nodes = sorted({n for u, v, _ in links for n in (u, v)})
    marks = [(n, f"m{rng.randrange(3)}", f"v{rng.randrange(3)}") for n in nodes for _ in range(2)]
    rounds, safe = [], identity._safe
    monkeypatch.setattr(identity, "_safe", lambda *a: rounds.append(1) or safe(*a))
    for many, by_rounds in ((100, False), (5, True)):
        monkeypatch.setattr(identity, "MANY", many, raising=False)
        assert found(spark, links, marks, tail=20) == brute(links, marks)
        assert bool(rounds) == by_rounds


def test_components_read_all_links_once(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)] + [(600 - i, 601 + i) for i in range(20)]
    given, of = [], entity.components
    monkeypatch.setattr(entity, "components", lambda edges: given.append(edges.count()) or of(edges))
    got = {r["node"]: r["root"] for r in entity.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == brute_components({n for link in links for n in link}, links)
    assert len(given) > 1 and all(n < given[0] / 2 for n in given[1:])


def test_dense_ranks_by_products_equal_meeting_all_pairs(spark, monkeypatch):
    """Copies, negative scores and vectors of another length, with a null or none at all, in rounds of few queries and products."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "PRODUCTS", 50)
    rng = random.Random(8)
    vector = lambda: [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)] + [0.25]
    rows = [(i, vector()) for i in range(300)] + [(400 + i, [1.0, 0.5, 2.0, 0.25]) for i in range(40)] + [(500, None), (501, [1.0, None, 0.5, 0.5]), (502, [1.0, 2.0])]
    asked = [(i, v) for i, v in rows if i % 20 == 0 or i > 500]

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return -math.inf
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return round(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 6)

    want = {(q, n + 1): k for q, qv in asked for n, (_, k) in enumerate(sorted((-cosine(v, qv), k) for k, v in rows)[:9])}
    index, queries = spark.createDataFrame(rows, "k long, v array<float>"), spark.createDataFrame(asked, "query long, qv array<float>")
    out = retrieval.dense_rank(index, queries, "k", "v", 9).collect()
    assert len(out) == 9 * len(asked) and {(r["query"], r["rank"]): r["k"] for r in out} == want
