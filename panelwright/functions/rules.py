"""Text rules with their tables of patterns as parameters: what a remark, a cell or a label says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.dates import partial_date
from panelwright.functions.text import BLANK, trimmed

#: Characters around a word: neither letters nor digits.
EDGE = r"[^\p{L}\p{N}_]"
#: Openings of remarks that are printed for every row, words of an open interval, and honorifics.
TEMPLATES = (r"Status as on [0-9]{2}/[0-9]{4}\s*:", r"Remarks\s*:", r"(?:nil|no)\s+report\b")
ABOVE, BELOW = ("more than", "above", "over", "exceeding", ">=", ">"), ("up to", "upto", "less than", "below", "under", "not exceeding", "<=", "<")
HONORIFICS = ("Shri", "Smt", "Mr", "Mrs", "Ms", "Dr", "Prof")


def free_text(text: Column, templates: tuple[str, ...] = TEMPLATES, least_words: int = 3) -> Column:
    """text without its templates, white space made single; null if fewer than least_words words are left.

    A template that begins with the rest of a line can only match at the line's beginning or where the last match ended, so it is tried there alone:
    from every character, a long line would take time by the square."""
    bare = F.coalesce(text, F.lit(""))
    for pattern in templates:
        at = r"(?:(?<![^\n])|\G)" if pattern.startswith(r"[^\n]*") and "|" not in pattern else ""
        bare = F.regexp_replace(bare, f"(?i){at}{pattern}", " ")
    bare = trimmed(F.regexp_replace(bare, rf"{BLANK}+", " "))
    return F.when(F.size(F.filter(F.split(bare, " "), lambda w: w != "")) >= least_words, bare)


def interval(text: Column, above: tuple[str, ...] = ABOVE, below: tuple[str, ...] = BELOW) -> Column:
    """Struct lo, hi of a condition in words: '5 to 40 ha', 'more than 5', 'up to 40 ha', 'above 5 and up to 40'; open ends are 0 and infinity, and so
    are both where no bound is named. The longer words of a list are tried first."""
    words = lambda these: "|".join(sorted((w.replace(" ", r"\s+") for w in these), key=len, reverse=True))
    number = r"([0-9]+(?:\.[0-9]+)?)"
    part = lambda pattern, i=1: F.regexp_extract(text, f"(?i){pattern}", i).try_cast("double")
    span = number + r"\s*(?:ha\s*)?(?:to|-|–)\s*" + number
    hi = part(rf"(?:{words(below)})\s*{number}")
    lo = part(rf"(?:^|{EDGE})(?:{words(above)})\s*{number}")
    # 'not exceeding 5' holds 'exceeding 5' too
    lo = F.when(text.rlike(rf"(?i)not\s+(?:{words(above)})"), F.lit(None)).otherwise(lo)
    return F.struct(F.coalesce(part(span), lo, F.lit(0.0)).alias("lo"), F.coalesce(part(span, 2), hi, F.lit(float("inf"))).alias("hi"))


def names_a_person(text: Column, honorifics: tuple[str, ...] = HONORIFICS) -> Column:
    """Whether an honorific stands before a capitalised name; case counts."""
    return F.coalesce(text, F.lit("")).rlike(rf"(?:^|{EDGE})(?:{'|'.join(honorifics)})\.?\s+\p{{Lu}}\p{{Ll}}+")


def numbers_of_form(text: Column, pattern: str) -> Column:
    """Identifiers of a form that text names, without white space, in upper case, once each in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){pattern}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"\s", ""))))


def label(text: Column, aliases: dict[str, str], several: str = "Multi", separators: str = "[,/&]") -> Column:
    """The label of a printed one by its aliases (in lower case), completed where it is clipped to a beginning that only one alias's label has;
    several for two or more different known labels, null if one is unknown."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    known = sorted(aliases.items())

    def one(part: Column) -> Column:
        name = F.lower(F.trim(part))
        begins = F.array_distinct(F.array_compact(F.array(*[F.when((F.length(name) >= 4) & F.startswith(F.lit(a), name), F.lit(v)) for a, v in known])))
        return F.coalesce(F.try_element_at(table, name), F.when(F.size(begins) == 1, F.get(begins, F.lit(0))))

    parts = F.array_distinct(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda p: F.trim(p) != ""), one))
    return F.when((F.size(parts) == 0) | F.exists(parts, lambda x: x.isNull()), F.lit(None)).when(F.size(parts) > 1, F.lit(several)).otherwise(F.get(parts, F.lit(0)))


def name_key(text: Column) -> Column:
    """A key that compares names however they are spelt: upper case, & as AND, points and double spaces dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.upper(text), F.lit("&"), F.lit(" AND ")), r"[.]", ""), r"\s+", " "))


def last_date(text: Column, upto: Column, forms: tuple[tuple[str, str], ...] = ((r"[0-9]{2}-[0-9]{2}-[0-9]{4}", "dd-MM-yyyy"), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"), (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"))) -> Column:
    """The last date up to a day that a text names in one of the forms; impossible dates are none."""
    read = lambda form: lambda d: F.try_to_timestamp(d, F.lit(form)).cast("date")
    named = F.concat(*[F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), read(form)) for pattern, form in forms])
    return F.array_max(F.filter(named, lambda d: d <= upto))


def completed(labels: DataFrame, clips: DataFrame, label_column: str, clip_column: str, least: int = 4) -> DataFrame:
    """clips with label, the only label that begins with the clip, null if there are several or none or the clip is shorter than least.

    Labels are cut at every length and met by equality: no pair of a clip with a label that does not begin so."""
    begun = labels.select(F.col(label_column).alias("_l")).distinct().where(F.length("_l") >= least)
    cuts = begun.select("_l", F.explode(F.transform(F.sequence(F.lit(least), F.length("_l")), lambda n: F.substring("_l", F.lit(1), n))).alias("_c"))
    whole = cuts.groupBy("_c").agg(F.min("_l").alias("_f"), F.count("*").alias("_n"))
    return clips.join(whole, F.col(clip_column) == F.col("_c"), "left").withColumn("label", F.when(F.col("_n") == 1, F.col("_f"))).drop("_c", "_f", "_n")


def banded(number: Column, bands: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The word of the first band whose upper end is above a number (bands ascend), rest above them all; null for null."""
    word = F.lit(rest)
    for upper, name in reversed(bands):
        word = F.when(number < upper, F.lit(name)).otherwise(word)
    return F.when(number.isNotNull(), word)


def reworded(text: Column, policy: list[tuple[str, Callable[[Column], Column]]], dropped: tuple[str, ...] = ()) -> Column:
    """text with what each pattern of a policy finds replaced by the word that its rule makes of the pattern's first group, in the policy's order; what the
    dropped patterns find goes. A null text stays null, and a match for which the rule gives null goes too.

    Regular expressions cannot compute a replacement, so a text is cut at the matches and joined again with the words between; all in
    array functions. Patterns must not match an empty string.
    """
    def step(pattern: str, rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def apply(t: Column) -> Column:
            found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.coalesce(rule(x), F.lit("")))
            return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

        return apply

    out = text
    for pattern, rule in policy:
        out = F.get(F.transform(F.array(out), step(pattern, rule)), F.lit(0))  # names the text, which a step reads twice
    for pattern in dropped:
        out = F.regexp_replace(out, pattern, "")
    return out


def dated_fact(published: Column, event: Column, asof: Column, live_months: int) -> Column:
    """Struct event_date, precision, stands_in and live of a report: an event told as YYYY, YYYY-MM or YYYY-MM-DD and the day it was published.

    An event after its publication is a plan, not an event: then, and where it cannot be read, the day of publication stands in. A fact is
    live if its date is at most live_months before asof and not after it; without any date it is not.
    """
    told = partial_date(event)
    bad = told.isNull() | F.coalesce(told["date"] > published.cast("date"), F.lit(False))
    date = F.when(~bad, told["date"])
    at = F.coalesce(date, published.cast("date"))
    live = (at > F.add_months(asof.cast("date"), -live_months)) & (at <= asof.cast("date"))
    return F.struct(date.alias("event_date"), F.when(~bad, told["precision"]).alias("precision"), (bad & published.isNotNull()).alias("stands_in"), F.coalesce(live, F.lit(False)).alias("live"))
