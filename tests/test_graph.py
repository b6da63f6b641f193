"""Graph components of the whole tables against union-find."""

from panelwright.plans import registry


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in links:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_graph_components_take_every_link(spark, tmp_path):
    # A chain of 60 customers and suppliers, a pair of its own, and a customer and a supplier without orders.
    orders, items = [(i, i) for i in range(1000, 1060)] + [(2000, 2000)], []
    for i in range(1000, 1060):
        items += [(i, i), (i, i + 1)]
    items.append((2000, 5000))
    customers, suppliers = [*range(1000, 1060), 2000, 3000], [*range(1000, 1061), 5000, 6000]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c,) for c in customers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(s,) for s in suppliers], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    buyer = dict(orders)
    links = [(2 * buyer[o], 2 * s + 1) for o, s in items]
    expected = brute_components([2 * c for c in customers] + [2 * s + 1 for s in suppliers], links)
    got = {r["node"]: r["root"] for r in registry.QUERIES["er_graph_components"](spark, str(tmp_path)).collect()}
    assert got == expected
