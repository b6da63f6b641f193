"""Text normalisation, similarity and rule tagging with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's space separators, which trim() takes off in SQL; the white space of a pattern there (no vertical tab).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BLANK = r"[\t\n\f\r ]"


def trimmed(text: Column) -> Column:
    """text without space separators at its ends. As a function of higher order needs one argument: F.trim has two, and would get the place."""
    return F.trim(text, F.lit(SPACES))


def normalise_name(name: Column, abbreviations: dict[str, str] | None = None, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case words of a name without punctuation, abbreviations spelled out, stop words dropped."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    if abbreviations:
        table = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair])
        tokens = F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop_words))
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def normalise_code(code: Column, placeholders: tuple[str, ...] = ("NA", "NIL", "NONE", "0", "")) -> Column:
    """Upper-case letters and digits of a code; placeholders are null."""
    bare = F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")
    return F.when(~bare.isin(*placeholders), bare)


def padded_code(code: Column, prefix: str, width: int) -> Column:
    """prefix and the code's digits, padded with zeros; null without digits."""
    digits = F.regexp_extract(code, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit(prefix), F.lpad(digits, width, "0")))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union of two token arrays in their intersection; null when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union.cast("double"))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest.cast("double"))


def fuzzy_jaccard(a: Column, b: Column, least: float = 0.85) -> Column:
    """Jaccard of token arrays where tokens match at an edit ratio of at least least."""
    hits = F.size(F.filter(a, lambda x: F.exists(b, lambda y: edit_ratio(x, y) >= least)))
    union = F.size(a) + F.size(b) - hits
    return F.when(union > 0, hits / union.cast("double"))


def typo_only(a: Column, b: Column, most: int = 2) -> Column:
    """Whether two normalised names differ by a few edits and in no digit."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return (F.levenshtein(a, b) <= most) & (digits(a) == digits(b)) & (a != b)


def numbers(text: Column) -> Column:
    """Numbers in text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def max_number(text: Column, pattern: str, group: int = 1) -> Column:
    """Largest number that a group of the pattern captures; null without a match."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x.try_cast("double")))


def unsupported_numbers(text: Column, facts: Column, tolerance: float = 0.5) -> Column:
    """Numbers of text that are near none of the array of facts."""
    return F.filter(numbers(text), lambda n: ~F.exists(facts, lambda f: F.abs(f - n) <= tolerance))


def sentences(text: Column, least: int = 3) -> Column:
    """Sentences with at least so many characters, trimmed."""
    marked = F.regexp_replace(text, rf"([.!?]){BLANK}+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), trimmed), lambda s: F.length(s) >= least)


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern is found."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules])


def tags(text: Column, taxonomy: list[tuple[str, str]]) -> Column:
    """Labels of all rules whose patterns are found, in the order of the taxonomy."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in taxonomy]))


def snippet(text: Column, pattern: str, before: int = 20, width: int = 60) -> Column:
    """A stretch of text around the first match; null without one."""
    at = F.regexp_instr(text, F.lit(f"({pattern})"))
    return F.when(at > 0, F.substr(text, F.greatest(at - before, F.lit(1)), F.lit(width)))


def bracketed_acronym(text: Column) -> Column:
    found = F.regexp_extract(text, r"\(([A-Z]{2,})\)", 1)
    return F.when(found != "", found)


def one_line(text: Column, most: int = 300) -> Column:
    """Outside text on one line without control characters or angle brackets, cut at most."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[<>\p{Cntrl}]", " "), r"\s+", " ")
    return F.substring(F.trim(bare), 1, most)


def scrub_emails(text: Column, mark: str = "[email]") -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", mark)


def non_latin_share(text: Column) -> Column:
    """Share of letters beyond Latin blocks; null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"[^\x00-ɏ]")) / letters.cast("double"))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.parse_url(url, F.lit("HOST")), r"^www\.", "")


def story_key(title: Column) -> Column:
    """Headline without the source after its last dash, lower-case letters and digits only."""
    head = F.regexp_replace(title, r"\s+-\s+[^-]*$", "")
    return F.regexp_replace(F.lower(head), "[^a-z0-9]+", " ")


def km_range(text: Column) -> Column:
    """A struct lo, hi of 'km a to km b', metres after a + sign; null if none or reversed by a misreading."""
    pattern = r"(?i)km\.?\s*(\d+)(?:\+(\d{1,3}))?\s*(?:to|-)\s*(?:km\.?\s*)?(\d+)(?:\+(\d{1,3}))?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    at = lambda km, m: part(km).try_cast("double") + F.coalesce(part(m).try_cast("double"), F.lit(0.0)) / 1000
    lo, hi = at(1, 2), at(3, 4)
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def share_done(text: Column) -> Column:
    """Share from 'a of b ha' or 'a/b ha', else from a percentage; null without either or beyond 0 to 1."""
    ratio = r"(?i)(\d+(?:\.\d+)?)\s*(?:ha|acres?)?\s*(?:of|out of|/)\s*(\d+(?:\.\d+)?)\s*(?:ha|acres?)"
    a, b = (F.regexp_extract(text, ratio, i).try_cast("double") for i in (1, 2))
    percent = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?:%|per ?cent)", 1).try_cast("double") / 100
    share = F.coalesce(F.when(b > 0, a / b), percent)
    return F.when(share.between(0, 1), share)


def cue_state(text: Column, cue: str, states: list[tuple[str, str]]) -> Column:
    """State whose verb comes first after the cue; ties to the earlier state; null without the cue or a verb."""
    after = F.regexp_extract(text, f"(?is){cue}(.*)$", 1)
    at = F.array(*[F.struct(F.regexp_instr(after, F.lit(f"((?i){verb})")).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("state")) for i, (name, verb) in enumerate(states)])
    return F.array_min(F.filter(at, lambda s: s["at"] > 0))["state"]


def road_ids(text: Column) -> Column:
    """Numbers of the roads a text names, sorted and joined by ';'; null without any. Where one is tagged NEW the untagged
    ones do not count; those tagged OLD, ERSTWHILE or JUNCTION never do. Leading zeros are dropped."""
    up = F.upper(text)
    pattern = F.lit(r"(?:\b(NEW|OLD|ERSTWHILE|JUNCTION)\W+)?\bNH[\s.-]*0*([1-9]\d{0,2}[A-Z]?)\b")
    tags, ids = F.regexp_extract_all(up, pattern, F.lit(1)), F.regexp_extract_all(up, pattern, F.lit(2))
    new = F.array_contains(tags, "NEW")
    kept = F.filter(ids, lambda _, i: (F.get(tags, i) == "NEW") | (~new & (F.get(tags, i) == "")))
    return F.when(F.size(kept) > 0, F.array_join(F.array_sort(F.array_distinct(kept)), ";"))


def is_linear(group: Column, name: Column, always: list[str], groups: list[str], linear: str, other: str) -> Column:
    """Whether a project is a line: some groups always are; else a name matching linear is, one matching other is not, and
    the rest follow groups. Null names match nothing."""
    named, not_named = (F.coalesce(F.lower(name).rlike(p), F.lit(False)) for p in (linear, other))
    return named | F.coalesce(group.isin(always), F.lit(False)) | (~not_named & F.coalesce(group.isin(groups), F.lit(False)))


def canonical(name: Column, aliases: dict[str, str], noise: tuple[str, ...], junk: tuple[str, ...]) -> Column:
    """A struct of the canonical form of a printed name and the rule that gave it, the first of: missing, invalid (junk),
    alias, bracket (an acronym after two words or more), prefix (a known code before FOR or OF), alias_prefix (the longest
    alias that begins the name), normalised."""
    known = {a: c for a, c in aliases.items()} | {c: c for c in aliases.values()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def bare(x: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(x), "&", " AND "), "[^A-Z0-9]+", " ")), " ")
        return F.regexp_replace(F.array_join(F.filter(words, lambda w: ~w.isin(*noise)), " "), r"(?: (?:I|II|III|IV))+$", "")

    s, code = bare(name), F.regexp_extract(name, r"\(([A-Z]{2,10})\)", 1)
    rest, first = F.size(F.split(bare(F.regexp_replace(name, r"\([A-Z]{2,10}\)", " ")), " ")), F.element_at(F.split(s, " "), 1)
    head = F.coalesce(*[F.when(s.startswith(a + " "), F.lit(c)) for a, c in sorted(aliases.items(), key=lambda p: (-len(p[0]), p[0]))])

    def found(value, rule: str) -> Column:
        return F.struct(value.cast("string").alias("name"), F.lit(rule).alias("rule"))

    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", found(F.lit(None), "missing"))
        .when(s.isin("", *junk), found(F.lit(None), "invalid"))
        .when(F.element_at(table, s).isNotNull(), found(F.element_at(table, s), "alias"))
        .when((code != "") & (rest >= 2), found(F.coalesce(F.element_at(table, code), code), "bracket"))
        .when(s.rlike(r"^[A-Z0-9]+ (FOR|OF)\b") & F.element_at(table, first).isNotNull(), found(F.element_at(table, first), "prefix"))
        .when(head.isNotNull(), found(head, "alias_prefix"))
        .otherwise(found(s, "normalised"))
    )
