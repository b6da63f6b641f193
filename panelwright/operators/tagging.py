"""Tagging of texts sentence by sentence with a taxonomy given as a table: category, subtype, authority and whether it is resolved.

A category is one alternation of its subtypes' patterns, so a sentence is searched once a category; only a sentence that matches is asked which
subtype it is, the first in the table's order that matches. Patterns are searched in any case of letters; (?-i:...) keeps the case of an acronym.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.text import BLANK, trimmed


@dataclass(frozen=True)
class Taxonomy:
    """rows are (category, subtype, pattern); authorities (name, pattern). A sentence is resolved if done matches and, after what not_blocked
    matches is taken out, blocked does not; where a percentage is printed beside share_of, it decides: share or more is resolved."""

    rows: tuple[tuple[str, str, str], ...]
    authorities: tuple[tuple[str, str], ...] = ()
    done: str = r"\b(?:done|completed?|obtained|received|granted|resolved|cleared)\b"
    blocked: str = r"\b(?:pending|awaited|delay\w*|held up|not yet)\b"
    not_blocked: str = r"\b(?:no|without) delays?\b"
    share_of: dict[str, str] | None = None
    share: float = 95.0

    def categories(self) -> list[str]:
        return list(dict.fromkeys(c for c, *_ in self.rows))

    def patterns(self, category: str) -> list[tuple[str, str]]:
        return [(s, p) for c, s, p in self.rows if c == category]


#: Kinds of remarks on works, by what they name.
REMARKS = Taxonomy(
    rows=(
        ("land", "acquisition", r"\bland\s+acqui\w+|\bacquisition\s+of\s+land"),
        ("land", "compensation", r"\bcompensation\b"),
        ("land", "possession", r"\bpossession\b|\bhand(?:ing|ed)\s+over\s+of\s+land"),
        ("land", "encroachment", r"\bencroach\w*"),
        ("forest", "clearance", r"\bforest\w*|(?-i:\bFC\b)"),
        ("forest", "wildlife", r"\bwild\s*life\b|\bsanctuary\b|\bnational\s+park\b"),
        ("litigation", "court", r"\b(?:high|supreme)?\s*courts?\b|\bwrit\b"),
        ("litigation", "arbitration", r"\barbitra\w*"),
        ("contractor", "termination", r"\bterminat\w*|\bforeclos\w*"),
        ("contractor", "insolvency", r"\binsolven\w*|\bbankrupt\w*"),
        ("contractor", "performance", r"\bcontractors?\b.{0,40}\b(?:slow|poor|default\w*|abandon\w*)"),
        ("funding", "constraint", r"\bfunds?\s+(?:constraint|shortage|crunch)|\b(?:paucity|shortage|lack)\s+of\s+funds?\b"),
        ("funding", "payment", r"\bpayments?\s+(?:pending|due|delayed)"),
        ("utilities", "shifting", r"\butilit\w+\s+shift\w*|\bshifting\s+of\s+(?:\w+\s+){0,2}(?:utilit\w+|lines?|poles?|cables?)"),
        ("approval", "railway", r"\brailways?\s+(?:approval|clearance|permission)"),
        ("approval", "no objection", r"(?-i:\bNOCs?\b)|\bno\s+objection"),
        ("law and order", "agitation", r"\bagitat\w*|\bprotests?\b|\bstrikes?\b|\bblockade\b"),
        ("weather", "rain", r"\bmonsoon\w*|\bheavy\s+rains?\b"),
        ("weather", "flood", r"\bflood(?:s|ed|ing)?\b|\bcyclone\b|\blandslides?\b"),
    ),
    authorities=(("forest department", r"\bforest\s+dep\w+"), ("railways", r"\brailways?\b"), ("court", r"\bcourts?\b"), ("state government", r"\bstate\s+gov\w+")),
    share_of={"land": r"([0-9]+(?:\.[0-9]+)?)\s*%"},
)


def _any(patterns: Iterable[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def split_sentences(text: Column) -> Column:
    """Sentences of more than three characters, trimmed; 'Stage - I' stays together."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)\b(stage|phase){BLANK}+-{BLANK}+", "$1-")
    return F.filter(F.transform(F.split(F.regexp_replace(joined, rf"([.!?;]){BLANK}+", "$1\n"), "\n"), trimmed), lambda s: F.length(s) > 3)


def first_of(sentence: Column, patterns: list[tuple[str, str]]) -> Column:
    """The first name whose pattern matches, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(sentence.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


def resolved(sentence: Column, category: Column, taxonomy: Taxonomy) -> Column:
    told = sentence.rlike("(?i)" + taxonomy.done)
    for name, pattern in (taxonomy.share_of or {}).items():
        part = F.regexp_extract(sentence, "(?i)" + pattern, 1).try_cast("double")
        told = F.when((category == name) & part.isNotNull(), part >= taxonomy.share).otherwise(told)
    held = F.regexp_replace(sentence, "(?i)" + taxonomy.not_blocked, " ").rlike("(?i)" + taxonomy.blocked)
    return told & ~held


def tag_sentences(df: DataFrame, keys: list[str], text: str, taxonomy: Taxonomy) -> DataFrame:
    """keys, place of the sentence, sentence, category, subtype, authority and resolved: a row for each sentence and category it matches."""
    rows = df.select(*keys, F.posexplode(split_sentences(F.col(text))).alias("place", "sentence"))
    s = F.col("sentence")
    hits = F.array_compact(F.array(*[F.when(s.rlike(_any(p for _, p in taxonomy.patterns(c))), F.lit(c)) for c in taxonomy.categories()]))
    found = rows.select(*keys, "place", "sentence", F.explode(hits).alias("category"))
    subtype = F.lit(None).cast("string")
    for c in taxonomy.categories():
        subtype = F.when(F.col("category") == c, first_of(s, taxonomy.patterns(c))).otherwise(subtype)
    return found.select(*keys, "place", "sentence", "category", subtype.alias("subtype"), first_of(s, list(taxonomy.authorities)).alias("authority"), resolved(s, F.col("category"), taxonomy).alias("resolved"))


def tag_texts(df: DataFrame, keys: list[str], text: str, taxonomy: Taxonomy) -> DataFrame:
    """Of each text and category the shortest matching sentence (then the first), how many matched, and whether all of them are resolved."""
    rows = tag_sentences(df, keys, text, taxonomy)
    best = F.min_by(F.struct("sentence", "subtype", "authority"), F.struct(F.length("sentence"), "place"))
    return rows.groupBy(*keys, "category").agg(best.alias("b"), F.count("*").alias("n"), F.bool_and("resolved").alias("resolved")).select(*keys, "category", "b.subtype", "b.authority", "b.sentence", "n", "resolved")
