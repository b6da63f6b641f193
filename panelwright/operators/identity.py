"""Identities from links that may be refused: components that hold at most one value of each mark, and clean keys by codes and
names built on them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.entity import components
from panelwright.sources.scratch import stored as _cut
from panelwright.sources.session import ship


#: Links of a home that a task takes one by one in a round, some 10 MB; homes of more than so many times that are worked on by rounds first.
TAIL, MANY = 50_000, 100
#: Links of a home whose rank is looked at to find its first ones, at most; a window's limit of as many rows is kept by the tasks before it.
PLACES = 1000


def _clash(own: dict, new: dict) -> list:
    return [m for m, values in new.items() if m in own and len(values | own[m]) > 1]


class _Home:
    """The components of a home by the links that it is given in their order."""

    def __init__(self):
        self.root, self.held, self.refused = {}, {}, []

    def top(self, n):
        while n in self.root:
            above = self.root[n]
            if above in self.root:
                self.root[n] = self.root[above]
            n = above
        return n

    def link(self, a, b, u, v) -> None:
        big, small = sorted((self.top(a), self.top(b)), key=lambda c: -len(self.held.get(c, ())))
        if big == small:
            return
        own, new = self.held.setdefault(big, {}), self.held.get(small, {})
        if clash := _clash(own, new):
            self.refused.append((u, v, min(clash)))
            return
        self.root[small] = big
        for m, values in new.items():
            own.setdefault(m, set()).update(values)

    def told(self) -> list[tuple]:
        return [*self.refused, *[(n, self.top(n), None) for n in self.root]]


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the homes of a partition, each with its marks (u null) and then its links in their order: the refused links with the first mark in the way,
    and the components that have joined another one, without a mark."""
    at, home, kind = None, _Home(), None

    def out(home: _Home) -> Iterator[pa.RecordBatch]:
        if rows := home.told():
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((kind, kind, pa.string()))], ["u", "v", "refused"])

    for batch in batches:
        kind = batch.schema.field("u").type
        for of, a, b, u, v, mark, value in zip(*[c.to_pylist() for c in batch.columns]):
            if of != at:
                yield from out(home)
                at, home = of, _Home()
            if u is None:
                home.held.setdefault(a, {}).setdefault(mark, set()).add(value)
            else:
                home.link(a, b, u, v)
    yield from out(home)


def constrained_components(links: DataFrame, marks: DataFrame, order: list[str], tail: int = TAIL) -> tuple[DataFrame, DataFrame]:
    """Union of nodes by links in the order given, where a link is refused if the merged component would hold two values of one mark.

    links has u, v and the columns order (equal ones go by the smaller and then the larger end); marks has node, mark and value: two rows of one
    list are a mark with the row as value, an identifier's system is a mark with the code as value. A link is refused if one side has a value that
    differs from a value of the other side. Returns node and root (the smallest node of its component) for all nodes
    of links, and the links with refused, the first mark in the way, null for those that hold.

    The result is that of taking the links one by one. What is in reach, the components of all links, is found once and called a home; where all of it
    has one value of each mark all links hold. Links are taken in rounds. In each, the first open links of a home, about tail, are taken one by one in a
    task; then a link between components that clash is refused, as components only grow, and the rest is open. In homes of more than MANY times tail
    links (all with a tail of 0) a round decides what no open link can change instead: a component's first open link holds if, for each of
    its marks, the other end has it already (with the same value, and so never takes another) or no component within reach with another value
    has an earlier open link, as nothing that clashes can have joined the other end before; and so it
    does if it is the first one of both ends. A component is rows of marks and links, never gathered beyond a task's first links, and is left out once
    it has no open link; every round is written to the shared folder.
    """
    ship(links.sparkSession)
    rank = F.struct(*order, F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    open_ = _cut(links.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(rank).alias("rank")))
    alone = links.where("u = v").select(F.col("u").alias("node")).distinct()
    homes = components(open_) if open_.take(1) else alone.limit(0).withColumn("root", F.col("node"))
    homed = marks.join(homes.select("node", F.col("root").alias("home")), "node")
    contested = homed.groupBy("home", "mark").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b").select("home", "mark")
    held = _cut(homed.join(contested, ["home", "mark"], "left_semi").select(F.col("node").alias("comp"), "home", "mark", "value").distinct())
    in_doubt = held.select(F.col("home").alias("root")).distinct()
    where_ = _cut(homes.join(in_doubt, "root", "left_semi").select("node", F.col("root").alias("home"), F.col("node").alias("comp")))
    open_ = _cut(open_.join(where_.select(F.col("node").alias("u"), "home"), "u").select("home", "u", "v", "rank", F.col("u").alias("a"), F.col("v").alias("b")))
    refused = []

    def clashing(open_: DataFrame, held: DataFrame) -> DataFrame:
        """The open links between components that do not clash; the others are refused."""
        side = lambda end: held.select(F.col("comp").alias(end), "mark", F.col("value").alias(f"v_{end}"))
        # Many links join the same two components, which are compared once.
        clashes = open_.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "mark"]).where("v_a <> v_b").groupBy("a", "b").agg(F.min("mark").alias("refused"))
        judged = _cut(open_.join(clashes, ["a", "b"], "left"))
        refused.append(judged.where("refused IS NOT NULL").select("u", "v", "refused"))
        return judged.where("refused IS NULL").drop("refused")

    sizes = lambda df: df.groupBy("home").agg((F.count("*") > MANY * tail).alias("many"))
    by_size = _cut(sizes(open_))
    if by_size.where("many").take(1):
        open_ = clashing(open_, held)
    while open_.take(1):
        moves, rest = [], open_.join(by_size, "home")
        large, small = (rest.where(c).drop("many") for c in ("many", "NOT many"))
        if by_size.where("NOT many").take(1):
            one_in = max(1, tail // PLACES)
            seen = small.where(F.pmod(F.xxhash64("u", "v"), F.lit(one_in)) == 0)
            place = F.row_number().over(Window.partitionBy("home").orderBy("rank"))
            upto = seen.select("home", F.col("rank").alias("upto"), place.alias("place")).where(F.col("place") <= max(1, tail // one_in)).where(F.col("place") == max(1, tail // one_in))
            split = _cut(small.join(upto.drop("place"), "home", "left").withColumn("first", F.coalesce(F.col("rank") <= F.col("upto"), F.lit(True))).drop("upto"))
            first = split.where("first")
            ends = first.select(F.explode(F.array("a", "b")).alias("comp")).distinct()
            none = lambda like: F.lit(None).cast(like)
            kind, value = open_.schema["u"].dataType, held.schema["value"].dataType
            given = first.select("home", "rank", "a", "b", "u", "v", none("string").alias("mark"), none(value).alias("value"))
            theirs = held.join(ends, "comp", "left_semi").select("home", none(open_.schema["rank"].dataType).alias("rank"), F.col("comp").alias("a"), none(kind).alias("b"), none(kind).alias("u"), none(kind).alias("v"), "mark", "value")
            # A home's first links are small tables that make some work: the number of tasks is kept, whatever their size.
            dealt = theirs.unionByName(given).repartition(1 + first.count() // max(1, tail), "home").sortWithinPartitions("home", F.col("rank").asc_nulls_first())
            schema = open_.select("u", "v").schema.add("refused", "string")
            done = _cut(dealt.drop("rank").mapInArrow(_one_by_one, schema))
            refused.append(done.where("refused IS NOT NULL"))
            moves.append(done.where("refused IS NULL").select(F.col("u").alias("node"), F.col("v").alias("root")))
            left = split.where("NOT first").drop("first")
        else:
            left = small
        if by_size.where("many").take(1):
            left = left.unionByName(large)
            if (some := _cut(_safe(large, held))).take(1):
                moves.append(components(some).where("node <> root"))
        moved = _cut(reduce(DataFrame.unionByName, moves)) if moves else None
        of = (lambda df, end: df) if moved is None else (lambda df, end: df.join(moved.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root"))
        where_ = _cut(of(where_, "comp").select("node", "home", "comp"))
        open_ = _cut(of(of(left, "a"), "b").where("a <> b").select("home", "u", "v", "rank", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        going = open_.select(F.explode(F.array("a", "b")).alias("comp")).distinct()
        held = _cut(of(held, "comp").join(going, "comp", "left_semi").select("comp", "home", "mark", "value").distinct())
        open_ = clashing(open_, held)
        by_size = _cut(sizes(open_))
    in_way = reduce(DataFrame.unionByName, refused) if refused else links.select("u", "v").limit(0).withColumn("refused", F.lit(None).cast("string"))
    told = links.withColumn("_u", F.least("u", "v")).withColumn("_v", F.greatest("u", "v")).join(in_way.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "refused"), ["_u", "_v"], "left").drop("_u", "_v")
    whole = homes.join(in_doubt, "root", "left_anti").select("node", "root")
    parted = where_.join(where_.groupBy("comp").agg(F.min("node").alias("root")), "comp").select("node", "root")
    own = alone.join(homes, "node", "left_anti").select("node", F.col("node").alias("root"))
    return _cut(whole.unionByName(parted).unionByName(own)), told


def _safe(links: DataFrame, held: DataFrame) -> DataFrame:
    """Of open links none of which clashes, the ones that hold whatever becomes of the others: u and v, the components that they join."""
    ends = links.select("u", "v", "rank", F.inline(F.array(F.struct(F.col("a").alias("comp"), F.col("b").alias("other")), F.struct(F.col("b").alias("comp"), F.col("a").alias("other")))))
    first = _cut(ends.groupBy("comp").agg(F.min(F.struct("rank", "u", "v", "other")).alias("f")).select("comp", "f.*"))
    holders = held.join(first.select("comp", "rank", "other"), "comp")
    by_value = holders.groupBy("home", "mark", "value").agg(F.min("rank").alias("rank"))
    earliest = by_value.groupBy("home", "mark").agg(F.min(F.struct("rank", "value")).alias("e"))
    next_ = by_value.join(earliest, ["home", "mark"]).where(F.col("value") != F.col("e.value")).groupBy("home", "mark").agg(F.min("rank").alias("next"))
    rival = F.when(F.col("value") == F.col("e.value"), F.col("next")).otherwise(F.col("e.rank"))
    bare = holders.join(held.select(F.col("comp").alias("other"), "mark").distinct(), ["other", "mark"], "left_anti")
    unsafe = bare.join(earliest, ["home", "mark"]).join(next_, ["home", "mark"], "left").where(rival < F.col("rank")).select("comp").distinct()
    votes = first.join(unsafe.withColumn("_unsafe", F.lit(True)), "comp", "left").groupBy("u", "v").agg(F.count("*").alias("n"), F.bool_or(F.col("_unsafe").isNull()).alias("safe"), F.min("comp").alias("a"), F.max("other").alias("c"), F.min("other").alias("d"))
    return votes.where("n = 2 OR safe").select(F.col("a").alias("u"), F.when(F.col("c") == F.col("a"), F.col("d")).otherwise(F.col("c")).alias("v"))


def corroborated(links: DataFrame, rows: DataFrame, exact: float = 0.011, near: float = 0.01, alike_near: float = 0.1, alike: float = 0.25) -> DataFrame:
    """links (a, b) with detail, what speaks for a and b being one: an equal cost, a cost within near and names somewhat alike, or names alike.

    rows has code, name (words) and cost of what is printed under each code; null where nothing speaks for a link. Costs meet by buckets
    and names by their distinct spellings, so no two rows of a code are paired. One meeting tells both near and equal costs, as buckets
    of nearness are wider but for small costs, which meet once more; a cost of a is in one bucket, one of b in those that it reaches.
    """
    pairs = links.select("a", "b").distinct()
    told = rows.where("code IS NOT NULL")
    costs = told.where("cost IS NOT NULL").select("code", F.round("cost", 2).alias("cost")).repartition("code").distinct()
    names = told.where("name IS NOT NULL").select("code", "name").distinct()
    side = lambda df, end, value: df.select(F.col("code").alias(end), F.col(value).alias(f"{value}_{end}"))
    ours = pairs.join(side(costs, "a", "cost"), "a")
    theirs = side(costs, "b", "cost").join(pairs.select("b").distinct(), "b", "left_semi")
    gap, slack = F.abs(F.col("cost_a") - F.col("cost_b")), 1.001

    def met(left: DataFrame, bucket, low, high) -> DataFrame:
        spread = theirs.withColumn("k", F.explode(F.sequence(bucket(low), bucket(high))))
        return left.withColumn("k", bucket(F.col("cost_a"))).join(spread, ["b", "k"]).select("a", "b", (gap <= exact).alias("_equal"), (gap <= near * F.col("cost_b")).alias("_near"))

    cost = F.col("cost_b")
    logs = lambda c: F.floor(F.log(F.greatest(c, F.lit(1e-6))) / (2 * F.log1p(F.lit(2 * near))))
    small = ours.where(F.col("cost_a") < 2 * exact / near + exact) if near > 0 else ours
    by_cost = met(small, lambda c: F.floor(c / (4 * exact)), cost - slack * exact, cost + slack * exact)
    if near > 0:
        by_cost = by_cost.unionByName(met(ours, logs, cost * (1 - slack * near), cost * (1 + slack * near)))
    by_cost = by_cost.where("_equal OR _near").groupBy("a", "b").agg(F.bool_or("_equal").alias("_equal"), F.bool_or("_near").alias("_near"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    spelt = pairs.join(side(names, "a", "name"), "a").join(side(names, "b", "name"), "b").withColumn("wa", words(F.col("name_a"))).withColumn("wb", words(F.col("name_b")))
    shared = F.size(F.array_intersect("wa", "wb"))
    likeness = spelt.groupBy("a", "b").agg(F.max(F.coalesce(F.try_divide(shared, F.size("wa") + F.size("wb") - shared), F.lit(0.0))).alias("_alike"))
    found = pairs.join(by_cost, ["a", "b"], "left").join(likeness, ["a", "b"], "left")
    detail = F.when(F.col("_equal"), "cost").when(F.col("_near") & (F.col("_alike") >= alike_near), "near cost and name").when(F.col("_alike") >= alike, "name")
    return links.join(found.select("a", "b", detail.alias("detail")), ["a", "b"], "left")


def name_pairs(rows: DataFrame) -> DataFrame:
    """row, other: rows without a code and what they may continue, of the same stream, name and sector in the same, the previous or the next
    period of the stream and another list. A name that a list has twice tells nothing, for the row and for what it might continue; rows of
    different agencies are no pair.

    rows has row, code, stream, period, list, name, sector and agency. A name has one row a list, so a row meets few; rows of a name that a
    list has twice are met as that list, not one by one.
    """
    named = rows.where("name <> '' AND stream IS NOT NULL AND period IS NOT NULL AND list IS NOT NULL")
    many = named.groupBy("stream", "period", "list", "name").agg(F.count("*").alias("_n")).where("_n > 1").select("stream", "period", "list", "name", F.lit(True).alias("twice"))
    group = ["stream", "name", "sector"]
    told = _cut(named.join(many, ["stream", "period", "list", "name"], "left").select("row", "code", "period", "list", *group, "agency", F.coalesce("twice", F.lit(False)).alias("twice")))
    periods = rows.select("stream", "period").distinct()
    w = Window.partitionBy("stream").orderBy("period")
    around = periods.select("stream", "period", F.array_compact(F.array(F.lag("period").over(w), "period", F.lead("period").over(w))).alias("near"))
    asked = told.where("code IS NULL AND NOT twice").join(F.broadcast(around), ["stream", "period"]).select("row", *group, F.col("list").alias("own"), F.col("period").alias("at"), "agency", F.explode("near").alias("period"))
    elsewhere = (F.col("list") != F.col("own")) | (F.col("period") != F.col("at"))
    odd = asked.join(told.where("twice").select(*group, "period", "list").distinct(), [*group, "period"]).where(elsewhere).select("row").distinct()
    others = told.where("NOT twice").select(*group, "period", F.col("row").alias("other"), "list", F.col("agency").alias("o_agency"), F.col("code").alias("o_code"))
    met = asked.join(odd, "row", "left_anti").join(others, [*group, "period"]).where((F.col("row") != F.col("other")) & elsewhere)
    differ = F.coalesce((F.col("agency") != F.col("o_agency")) & (F.col("agency") != "") & (F.col("o_agency") != ""), F.lit(False))
    return met.where(~differ).select("row", "other", "o_code")


def clean_keys(rows: DataFrame, alternatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A key for each row, by codes and by chains of names, and the links tried with why a link does not hold.

    rows has row, code ("SYSTEM:id" or null), stream, period, list, name, name_words, sector, agency and cost; alternatives has a and b, codes printed side by side.
    A component holds at most one code of a system and one row of a list. Links between codes need corroboration and must be one to one
    among corroborated ones; rows without a code are chained by name_pairs(), and a chain whose rows continue rows of exactly one
    coded component joins it. A key is the smallest code, else NAME: and a digest of the earliest row's name, sector and period, numbered where several
    chains have the same.
    """
    node = F.coalesce("code", F.concat(F.lit("ROW:"), F.col("row").cast("string")))
    rows = _cut(rows.withColumn("node", node))
    slot = F.concat_ws("|", F.lit("list"), "stream", F.col("period").cast("string"), "list")
    system = lambda c: F.concat(F.lit("code "), F.substring_index(c, ":", 1))

    a_codes = alternatives.where("a <> b").select("a", "b").distinct()
    checked = corroborated(a_codes, rows.select("code", F.col("name_words").alias("name"), "cost")).withColumn("s", F.substring_index("b", ":", 1))
    good = checked.where("detail IS NOT NULL")
    taken = good.groupBy("b").agg(F.count_distinct("a").alias("n_a")).where("n_a > 1")
    spread = good.groupBy("a", "s").agg(F.count_distinct("b").alias("n_b")).where("n_b > 1")
    judged = checked.join(taken, "b", "left").join(spread, ["a", "s"], "left")
    why = F.when(F.col("detail").isNull(), "not corroborated").when(F.col("n_a").isNotNull() | F.col("n_b").isNotNull(), "one to many")
    judged = _cut(judged.select("a", "b", "detail", why.alias("why")))

    pairs = _cut(name_pairs(rows))
    chained = pairs.where("o_code IS NULL").select(F.concat(F.lit("ROW:"), F.col("row").cast("string")).alias("u"), F.concat(F.lit("ROW:"), F.col("other").cast("string")).alias("v"))
    links = judged.where("why IS NULL").select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("phase"))
    links = links.unionByName(chained.withColumn("phase", F.lit(1)))
    codes = rows.where("code IS NOT NULL").select("code").union(judged.where("why IS NULL").select(F.explode(F.array("a", "b")))).distinct()
    marks = rows.select("node", slot.alias("mark"), F.col("node").alias("value")).unionByName(codes.select(F.col("code").alias("node"), system(F.col("code")).alias("mark"), F.col("code").alias("value")))
    # Nodes without a link are their own roots and go through no union.
    roots, told = constrained_components(links, marks, ["phase"])
    linked = _cut(roots)
    rooted_by = lambda df, c, name: df.join(linked.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))

    rooted = rooted_by(rows.where("code IS NULL").select("node", "code", "row", "period", "name", "sector"), "node", "root")
    earliest = rooted.groupBy("root").agg(F.min(F.struct("period", "row", "name", "sector")).alias("e"), F.min("row").alias("least"))
    digest = F.concat(F.lit("NAME:"), F.substring(F.sha1(F.concat_ws("|", "e.name", "e.sector", F.col("e.period").cast("string"))), 1, 10))
    same = Window.partitionBy("base").orderBy("least")
    named = earliest.select("root", digest.alias("base"), "least").withColumn("n", F.row_number().over(same))
    named = _cut(named.select("root", F.when(F.col("n") > 1, F.concat_ws("-", "base", "n")).otherwise(F.col("base")).alias("name_key")))

    coded = pairs.where("o_code IS NOT NULL").select(F.concat(F.lit("ROW:"), F.col("row").cast("string")).alias("x"), F.col("o_code").alias("y"))
    aims = rooted_by(rooted_by(coded, "x", "chain"), "y", "aim").groupBy("chain", "aim").agg(F.count("*").alias("n"))
    several = aims.groupBy("chain").agg((F.count("*") > 1).alias("several"))
    wanted = _cut(aims.join(several, "chain").join(named, F.col("chain") == F.col("root")).select("chain", "aim", "n", "several", "name_key"))
    joins = wanted.where("NOT several").select(F.col("chain").alias("u"), F.col("aim").alias("v"), "name_key")
    ends = joins.select(F.explode(F.array("u", "v")).alias("root")).distinct()
    joined = linked.join(ends, "root", "left_semi").unionByName(ends.select(F.col("root").alias("node"), "root")).distinct()
    root_marks = marks.join(joined, "node").select(F.col("root").alias("node"), "mark", "value")
    last, told_names = constrained_components(joins, root_marks, ["name_key"])

    nodes = rooted_by(rows.where("code IS NULL").select("node").distinct().unionByName(codes.select(F.col("code").alias("node"))), "node", "root")
    final = _cut(nodes.join(last.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left").select("node", "root", F.coalesce("final", "root").alias("final")))
    smallest = codes.join(final, F.col("code") == F.col("node")).groupBy("final").agg(F.min("code").alias("smallest"))
    keys = final.join(smallest, "final", "left").join(named, "root", "left").select("node", "smallest", "name_key").where("smallest IS NOT NULL OR name_key IS NOT NULL")
    keyed = rows.select("row", "code", "node").join(keys, "node")
    key = F.coalesce("smallest", "name_key")
    source = F.when(F.col("code") == key, "printed code").when(F.col("code").isNotNull(), "crosswalk").when(F.col("smallest").isNull(), "name chain").otherwise("name link to code")
    tried = judged.join(told.select(F.col("u").alias("a"), F.col("v").alias("b"), "refused"), ["a", "b"], "left").select("a", "b", F.lit("code").alias("evidence"), F.coalesce("why", "refused").alias("why"))
    by_name = wanted.join(told_names.select(F.col("u").alias("chain"), F.col("v").alias("aim"), "refused"), ["chain", "aim"], "left").join(smallest, F.col("aim") == F.col("final"), "left")
    named_links = by_name.select(F.col("name_key").alias("a"), F.col("aim").alias("b"), F.lit("name").alias("evidence"), F.when(F.col("several"), "several").otherwise(F.col("refused")).alias("why"))
    return keyed.select("row", key.alias("key"), source.alias("source")), tried.unionByName(named_links)
