"""Texts linked to entities by distinctive words and an anchor, and the search strings of an entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.rules import EDGE
from panelwright.operators import ordering
from panelwright.sources.scratch import stored

#: Rows of the entities' tables (postings, anchors) up to which they are broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rules:
    """What makes a word distinctive and what counts as an anchor.

    most_df: entities that may share a distinctive word. code: pattern of a numbered object, its number as group 1, ('' for none).
    objects: kinds of object in order of precedence, of which generic ones anchor nothing. dropped: words that never tell entities apart.
    least, margin: the score a link needs, and how far the second best entity must stay behind.
    """

    most_df: int = 8
    code: str = ""
    code_prefix: str = ""
    objects: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    least: float = 0.5
    margin: float = 0.1


def words(text: Column) -> Column:
    """The distinct words of four letters or more, a to z, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))


def _codes(text: Column, rules: Rules) -> Column:
    if not rules.code:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rules.code), F.lit(1))
    return F.array_distinct(F.transform(found, lambda c: F.concat(F.lit(f"code:{rules.code_prefix}"), F.lower(c))))


def _named(text: Column, word: str) -> Column:
    """Whether a text names a kind of object, in any case, one or several."""
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)(?:^|{EDGE}){word}s?(?:{EDGE}|$)")


def _anchors(text: Column, rules: Rules) -> Column:
    """What a text offers as anchors: codes, kinds of object, and its words of up to eight letters as they are spelt."""
    kinds = [F.when(_named(text, o), F.lit(f"object:{o}")) for o in rules.objects if o not in rules.generic]
    objects = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    short = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![A-Za-z0-9_])[A-Za-z]{2,8}(?![A-Za-z0-9_])"), F.lit(0))
    return F.concat(_codes(text, rules), objects, F.transform(F.array_distinct(short), lambda w: F.concat(F.lit("short:"), w)))


def _small(df: DataFrame) -> DataFrame:
    """df, written once, and to be broadcast if it has few rows."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def profiles(entities: DataFrame, key: str, name: str, state: str, short: str, rules: Rules) -> DataFrame:
    """entity, name, places (distinctive words in name order), codes, object (the first kind named), short and state of each entity.

    A word is distinctive if at most most_df entities have it and neither the rules drop it nor the entity's state has it.
    """
    rows = entities.select(F.col(key).alias("entity"), F.col(name).alias("name"), F.col(state).alias("state"), F.col(short).alias("short"))
    every = rows.select("entity", F.explode(words(F.col("name"))).alias("word"))
    rare = every.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= rules.most_df).select("word")
    kept = every.join(rare, "word").groupBy("entity").agg(F.collect_set("word").alias("rare"))
    barred = F.concat(words(F.col("state")), F.array(*map(F.lit, rules.dropped)).cast("array<string>"))
    places = F.array_except(F.array_intersect(words(F.col("name")), F.coalesce("rare", F.array().cast("array<string>"))), barred)
    first = F.coalesce(*[F.when(_named(F.col("name"), o), F.lit(o)) for o in rules.objects], F.lit(None).cast("string"))
    return rows.join(kept, "entity", "left").select("entity", "name", "state", "short", places.alias("places"), _codes(F.col("name"), rules).alias("codes"), first.alias("object"))


def link(texts: DataFrame, key: str, text: str, known: DataFrame, rules: Rules) -> DataFrame:
    """key, entity, score and outcome (linked, ambiguous or none) of every text; known are profiles().

    Half of the score is for two shared distinctive words (a quarter for one), half for an anchor that the text shares: a code, a kind of object that is not
    generic, or the short name. No word has more than most_df entities, so a text meets a bounded number of them however common its words are
    among texts. A null text, or one without a word, links with nothing at score 0. Equal best scores are ambiguous. A repeated or null
    key is one text of all its rows' words.
    """
    rows = texts.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    own = [F.when(F.col("short").isNotNull(), F.concat(F.lit("short:"), F.col("short")))]
    own += [F.when(F.col("object").isNotNull() & ~F.col("object").isin(*rules.generic), F.concat(F.lit("object:"), F.col("object")))] if rules.objects else []
    entities = stored(known.select("entity", F.concat("codes", F.array_compact(F.array(*own))).alias("theirs"), "places"))
    postings = entities.select("entity", F.explode("places").alias("word"))
    # A place in the order of the words instead of the word: two words are shared if the least and the largest place differ.
    named = ordering.numbered(ordering.in_ranges(postings.select("word").distinct(), "word"), ["word"], "w").select("word", F.col("w").cast("int").alias("w"))
    met = rows.select("_k", F.explode(words(F.col("_t"))).alias("word")).join(_small(postings.join(named, "word")), "word").select("_k", "entity", "w")
    # A text's rows meet once: pairs, anchors and the best two are all by key.
    pairs = met.repartition("_k").groupBy("_k", "entity").agg((F.min("w") != F.max("w")).alias("several"))
    offered = rows.select("_k", F.explode(_anchors(F.col("_t"), rules)).alias("a")).join(_small(entities.select(F.explode("theirs").alias("a")).distinct()), "a")
    offered = offered.groupBy(F.col("_k").alias("_o")).agg(F.collect_set("a").alias("offered"))
    scored = pairs.join(offered, F.col("_k").eqNullSafe(F.col("_o")), "left").join(_small(entities.select("entity", "theirs")), "entity")
    anchored = F.coalesce(F.arrays_overlap("theirs", "offered"), F.lit(False))
    score = F.when(F.col("several"), 0.5).otherwise(0.25) + F.when(anchored, 0.5).otherwise(0.0)
    w = Window.partitionBy("_k").orderBy(F.desc("score"), F.desc("entity"))
    top = scored.select("_k", "entity", score.alias("score")).withColumn("second", F.lead("score").over(w)).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    outcome = F.when(F.col("score") < rules.least, "none").when(F.col("second") >= F.col("score") - rules.margin, "ambiguous").otherwise("linked")
    told = top.select(F.col("_k").alias("_o"), F.when(outcome == "linked", F.col("entity")).alias("entity"), "score", outcome.alias("outcome"))
    out = rows.select("_k").distinct().join(told, F.col("_k").eqNullSafe(F.col("_o")), "left")
    return out.select(F.col("_k").alias(key), "entity", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("outcome", F.lit("none")).alias("outcome"))


def aliases(generic: tuple[str, ...], no_state: tuple[str, ...], noise: str, least: int = 3, most: int = 5) -> Column:
    """Up to most search strings of a row of profiles(), each its first places with a second anchor.

    In order: two places and the object; three places and the state, where there are two or more; the code and a place; the short name with two
    places and an object that is not generic; the first and third place with the object. Where fewer than least are left, the name without its
    noise follows, six words of it, then four with the state. Strings of three characters or fewer are dropped.
    """
    places = F.slice(F.transform("places", lambda w: F.initcap(w)), 1, 3)
    n = F.size("places")
    first = F.get(places, F.lit(0))
    head = F.array_join(F.slice(places, 1, 2), " ")
    state = F.when(~F.col("state").isin(*no_state) & (F.col("state") != ""), F.col("state"))
    special = F.when(~F.col("object").isin(*generic), F.col("object"))
    code = F.regexp_replace(F.get("codes", F.lit(0)), "^code:", "")
    queries = [
        F.when(F.col("object").isNotNull(), F.concat_ws(" ", head, "object")),
        F.when(state.isNotNull() & (n > 1), F.concat_ws(" ", F.array_join(places, " "), state)),
        F.when(F.size("codes") > 0, F.concat_ws(" ", F.upper(code), first)),
        F.when(F.col("short").isNotNull(), F.concat_ws(" ", "short", head, special)),
        F.when(n > 2, F.concat_ws(" ", first, F.get(places, F.lit(2)), "object")),
    ]
    made = F.when(n > 0, F.array_distinct(F.array_compact(F.array(*queries)))).otherwise(F.array().cast("array<string>"))
    clean = F.filter(F.split(F.regexp_replace(F.coalesce("name", F.lit("")), noise, " "), r"\s+"), lambda w: w != "")
    plain = F.array(F.array_join(F.slice(clean, 1, 6), " "), F.trim(F.concat_ws(" ", F.array_join(F.slice(clean, 1, 4), " "), state)))
    every = F.array_distinct(F.when(F.size(made) < least, F.concat(made, plain)).otherwise(made))
    return F.slice(F.filter(every, lambda q: F.length(q) > 3), 1, most)


def classified(text: Column, categories: list[tuple[str, str]], severe: str, negative: str) -> Column:
    """Struct of the first category (None if none) whose pattern a text has, and its severity: 3, 2 or 1."""
    body = F.coalesce(text, F.lit(""))
    first = F.coalesce(*[F.when(body.rlike(pattern), F.lit(name)) for name, pattern in categories], F.lit(None).cast("string"))
    return F.struct(first.alias("category"), F.when(body.rlike(severe), 3).when(body.rlike(negative), 2).otherwise(1).alias("severity"))
