"""Identities built from links that may be refused. Rows only: a union that depends on the order of links is no SQL; tests compare with
taking links one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.dates import quarter_index
from panelwright.operators import identity
from panelwright.plans.registry import query
from panelwright.sources.scratch import stored
from panelwright.sources.tables import read


@query("er_constrained_components")
def er_constrained_components(spark, sf_dir):
    """Customers (c) and suppliers (s) joined by what they trade, the largest sums first; a component has customers of one segment and
    at most one supplier of a nation."""
    customer, supplier = F.concat(F.lit("c"), F.col("c").cast("string")), F.concat(F.lit("s"), F.col("s").cast("string"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    links = orders.join(items, "o_orderkey").groupBy("c", "s").agg((-F.sum("cents")).alias("less")).select(customer.alias("u"), supplier.alias("v"), "less")
    segments = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.lit("segment").alias("mark"), F.col("c_mktsegment").alias("value"))
    nations = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("mark"), F.col("s_suppkey").cast("string").alias("value"))
    roots, told = identity.constrained_components(stored(links), segments.unionByName(nations), ["less"])
    refused = told.where("refused IS NOT NULL").select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_refused"))
    return roots.join(refused, "node", "left").select("node", "root", F.coalesce("n_refused", F.lit(0)).cast("long").alias("n_refused"))


def printed_rows(spark, sf_dir):
    """Orders as the rows of quarterly lists: codes of the older system before 1995 and of the newer one since, none where the priority is
    not specified; and the codes printed side by side, right and wrong ones."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    all_ = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    old, new = F.concat(F.lit("OLD:"), F.col("o_custkey").cast("string")), F.concat(F.lit("NEW:"), (F.col("o_custkey") + 7).cast("string"))
    code = F.when(~F.col("o_orderpriority").startswith("4"), F.when(F.year("o_orderdate") < 1995, old).otherwise(new))
    rows = all_.select(
        F.col("o_orderkey").alias("row"),
        code.alias("code"),
        F.lit("orders").alias("stream"),
        quarter_index(F.col("o_orderdate")).alias("period"),
        F.col("o_orderpriority").alias("list"),
        F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", "").alias("name"),
        F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", " ").alias("name_words"),
        F.col("c_mktsegment").alias("sector"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("agency"),
        F.col("o_totalprice").cast("double").alias("cost"),
    )
    urgent = all_.where("o_orderpriority = '1-URGENT'")
    wrong = F.concat(F.lit("OLD:"), (F.col("c_nationkey") + 1).cast("string"))
    return rows, urgent.select(new.alias("a"), F.explode(F.array(old, wrong)).alias("b")).distinct()


@query("er_clean_keys")
def er_clean_keys(spark, sf_dir):
    """A key and its source for every order read as a printed row."""
    return identity.clean_keys(*printed_rows(spark, sf_dir))[0]


@query("er_key_links")
def er_key_links(spark, sf_dir):
    """The links between codes and from chains of names to codes, and why those that do not hold were refused."""
    return identity.clean_keys(*printed_rows(spark, sf_dir))[1]
