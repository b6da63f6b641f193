"""Components with refusals and clean keys against taking links and rows one by one."""

import hashlib
import random

import pytest

from panelwright.operators import identity
from panelwright.plans import registry


class OneByOne:
    def __init__(self, nodes, marks):
        self.root = {n: n for n in nodes}
        self.marks = {n: {} for n in nodes}
        for n, mark, value in marks:
            if n in self.marks:
                self.marks[n].setdefault(mark, set()).add(value)

    def top(self, n):
        while self.root[n] != n:
            n = self.root[n]
        return n

    def link(self, u, v):
        """The mark in the way, None if the link holds."""
        a, b = sorted((self.top(u), self.top(v)))
        if a == b:
            return None
        clash = [m for m in self.marks[a] if any(x != y for x in self.marks[a][m] for y in self.marks[b].get(m, ()))]
        if clash:
            return min(clash)
        self.root[b] = a
        for m, values in self.marks[b].items():
            self.marks[a].setdefault(m, set()).update(values)
        return None


def brute(links, marks):
    """Links as (u, v, rank): roots and refused ends."""
    state = OneByOne({n for u, v, *_ in links for n in (u, v)}, marks)
    refused = {}
    best = {}
    for u, v, rank in links:
        pair = (min(u, v), max(u, v))
        best[pair] = min(best.get(pair, rank), rank)
    for (u, v), _ in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if u != v and (why := state.link(u, v)):
            refused[u, v] = why
    return {n: state.top(n) for n in state.root}, {p for p in refused}


def found(spark, links, marks, tail=0):
    roots, told = identity.constrained_components(spark.createDataFrame(links, "u string, v string, rank int"), spark.createDataFrame(marks, "node string, mark string, value string"), ["rank"], tail)
    refused = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in told.where("refused IS NOT NULL").collect()}
    return {r["node"]: r["root"] for r in roots.collect()}, refused


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_links_one_by_one(spark, seed):
    rng = random.Random(seed)
    n, m = 40, (40, 80, 160)[seed % 3]
    links = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", rng.randrange(8 if seed % 2 else 1000)) for _ in range(m)]
    marks = [(f"n{i:02}", f"m{rng.randrange(3)}", f"v{rng.randrange(2 + seed)}") for i in range(n) for _ in range(rng.randrange(3))]
    expected = brute(links, marks)
    assert found(spark, links, marks, tail=500) == expected  # all on the driver
    if seed != 2:
        assert found(spark, links, marks, tail=20 * seed) == expected


def test_a_hub_takes_one_of_each_mark(spark):
    """All leaves of a star: pairs of one list, and codes of two systems."""
    links = [("hub", f"leaf{i:03}", i) for i in range(120)] + [("alone", "alone", 0), (f"leaf{5:03}", "far", 500)]
    marks = [(f"leaf{i:03}", f"list {i // 2}", f"leaf{i:03}") for i in range(100)] + [(f"leaf{i:03}", "code A", f"{i % 3}") for i in range(100, 120)]
    got = found(spark, links, marks)
    assert got == brute(links, marks)
    assert sum(root == got[0]["hub"] for root in got[0].values()) == 1 + 50 + 7  # hub, one of each pair, the leaves of the first code


def test_links_without_marks_and_no_links(spark):
    assert found(spark, [("a", "b", 1), ("b", "c", 2)], [("z", "m", "v")]) == ({"a": "a", "b": "a", "c": "a"}, set())
    assert found(spark, [], [("z", "m", "v")]) == ({}, set())
    assert found(spark, [("a", "b", 1), ("a", "b", 0)], [("a", "m", "1"), ("b", "m", "2")]) == ({"a": "a", "b": "b"}, {("a", "b")})


ROW = "row long, code string, stream string, period int, list string, name string, name_words string, sector string, agency string, cost double"


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a | b else 0.0


def brute_keys(rows, alternatives):
    fields = [c.split()[0] for c in ROW.split(", ")]
    rows = [dict(zip(fields, r)) for r in rows]
    node = {r["row"]: r["code"] or f"ROW:{r['row']}" for r in rows}
    by_code = {}
    for r in rows:
        if r["code"]:
            by_code.setdefault(r["code"], []).append(r)

    def speaks(a, b):
        if a not in by_code or b not in by_code:
            return False
        gaps = [(abs(round(x["cost"], 2) - round(y["cost"], 2)), round(y["cost"], 2)) for x in by_code[a] for y in by_code[b]]
        alike = max(jaccard(x["name_words"], y["name_words"]) for x in by_code[a] for y in by_code[b])
        return any(g <= 0.011 for g, _ in gaps) or (any(g <= 0.01 * c for g, c in gaps) and alike >= 0.1) or alike >= 0.25

    tried, good = {}, []
    for a, b in sorted(set(alternatives)):
        tried[a, b] = None if speaks(a, b) else "not corroborated"
        good += [(a, b)] if tried[a, b] is None else []
    system = lambda c: c.split(":")[0]
    for a, b in good:
        if len({x for x, y in good if y == b}) > 1 or len({y for x, y in good if x == a and system(y) == system(b)}) > 1:
            tried[a, b] = "one to many"
    marks = [(node[r["row"]], f"list|{r['stream']}|{r['period']}|{r['list']}", node[r["row"]]) for r in rows]
    codes = {r["code"] for r in rows if r["code"]} | {c for (a, b), why in tried.items() if why is None for c in (a, b)}
    state = OneByOne({*node.values(), *codes}, [*marks, *[(c, f"code {system(c)}", c) for c in codes]])
    for (a, b), why in sorted(tried.items(), key=lambda x: sorted(x[0])):
        if why is None:
            tried[a, b] = state.link(a, b)

    slot = lambda r: (r["stream"], r["period"], r["list"])
    repeats = {}
    for r in rows:
        repeats[slot(r), r["name"]] = repeats.get((slot(r), r["name"]), 0) + 1
    periods = sorted({r["period"] for r in rows})
    chained, coded = [], []
    for r in rows:
        if r["code"] or not r["name"] or repeats[slot(r), r["name"]] > 1:
            continue
        at = periods.index(r["period"])
        near = periods[max(0, at - 1) : at + 2]
        others = [o for o in rows if o is not r and o["period"] in near and slot(o) != slot(r) and (o["stream"], o["name"], o["sector"]) == (r["stream"], r["name"], r["sector"])]
        if any(repeats[slot(o), o["name"]] > 1 for o in others):
            continue
        for o in others:
            if not (r["agency"] and o["agency"] and r["agency"] != o["agency"]):
                (coded if o["code"] else chained).append((node[r["row"]], node[o["row"]]))
    for u, v in sorted({tuple(sorted(p)) for p in chained}):
        state.link(u, v)
    chains = {}
    for r in rows:
        if not r["code"]:
            chains.setdefault(state.top(node[r["row"]]), []).append(r)
    name_key, used = {}, set()
    for root in sorted(chains, key=lambda x: min(r["row"] for r in chains[x])):
        e = min(chains[root], key=lambda r: (r["period"], r["row"]))
        base = "NAME:" + hashlib.sha1(f"{e['name']}|{e['sector']}|{e['period']}".encode()).hexdigest()[:10]
        key, n = base, 2
        while key in used:
            key, n = f"{base}-{n}", n + 1
        used.add(key)
        name_key[root] = key
    aims = {}
    for u, v in coded:
        aims.setdefault(state.top(u), set()).add(state.top(v))
    for root in sorted(aims, key=lambda x: name_key[x]):
        if len(aims[root]) == 1:
            state.link(root, next(iter(aims[root])))
    final = {}
    for r in rows:
        top = state.top(node[r["row"]])
        own = sorted(c for c in codes if state.top(c) == top)
        final[r["row"]] = own[0] if own else name_key[next(x for x in name_key if state.top(x) == top)]
    return final, {p: w for p, w in tried.items()}


def printed(rng, n):
    rows = []
    for i in range(n):
        who = rng.randrange(12)
        code = rng.choice([None, None, f"A:{who}", f"B:{who + 100}"])
        name = f"name{who % 9}"
        rows.append((i, code, "s", rng.randrange(8), f"l{rng.randrange(3)}", name, f"name {who % 9} {code or ''}"[:8], f"sec{who % 2}", rng.choice(["x", "y", None, ""]), float(rng.randrange(1, 400))))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_clean_keys_equal_rows_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = printed(rng, 70)
    pairs = [(f"B:{w + 100}", f"A:{w if rng.random() < 0.7 else rng.randrange(12)}") for w in range(12)]
    got, links = identity.clean_keys(spark.createDataFrame(rows, ROW), spark.createDataFrame(pairs, "a string, b string"))
    keys, tried = brute_keys(rows, pairs)
    assert {r["row"]: r["key"] for r in got.collect()} == keys
    why = {(r["a"], r["b"]): r["why"] for r in links.where("evidence = 'code'").collect()}
    plain = lambda w: w if w in (None, "not corroborated", "one to many") else "refused"
    assert {p: plain(w) for p, w in why.items()} == {p: plain(w) for p, w in tried.items()}


def test_components_of_the_tables_hold_one_value_of_a_mark(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["er_constrained_components"](spark, sf).collect()
    segment = {f"c{r['c_custkey']}": r["c_mktsegment"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    nation = {f"s{r['s_suppkey']}": r["s_nationkey"] for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], []).append(r["node"])
    assert any(len(g) > 5 for g in groups.values())
    for g in groups.values():
        assert len({segment[n] for n in g if n in segment}) <= 1
        own = [nation[n] for n in g if n in nation]
        assert len(own) == len(set(own))
