"""Printed labels, remarks and names read by tables of rules that are parameters: the first rule that fits, all flags that fit, a place or a list of places, a shape."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A value, the patterns that columns must have, and those they must not have; a rule without patterns always fits."""

    value: str
    has: dict[str, str] = field(default_factory=dict)
    lacks: dict[str, str] = field(default_factory=dict)


def compact(text: Column) -> Column:
    """Letters A to Z and digits alone, in upper case: labels that differ in blanks, points or case are one."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def first_rule(columns: dict[str, Column], rules: list[Rule]) -> Column:
    """The value of the first rule that fits, in the table's order; null if none does. A null column reads as empty."""
    read = {name: F.coalesce(c.cast("string"), F.lit("")) for name, c in columns.items()}
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = F.lit(True)
        for name, pattern in rule.has.items():
            fits = fits & read[name].rlike(pattern)
        for name, pattern in rule.lacks.items():
            fits = fits & ~read[name].rlike(pattern)
        out = F.when(fits, F.lit(rule.value)).otherwise(out)
    return out


def flags(text: Column, table: list[tuple[str, str]]) -> Column:
    """The flags of all patterns that a text has, in the table's order, each once.

    A flag with {} is raised for each match and holds its first group; others are raised once. A null text raises none.
    """
    body = F.coalesce(text, F.lit(""))
    parts = []
    for pattern, flag in table:
        before, hole, after = flag.partition("{}")
        if hole:
            found = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
            parts.append(_filled(found, before, after))
        else:
            parts.append(F.when(body.rlike(pattern), F.array(F.lit(flag))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def _filled(found: Column, before: str, after: str) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(before), x, F.lit(after)))


def place_label(raw: Column, places: dict[str, str], special: dict[str, str], several: str, unknown: str, wrapper: str) -> Column:
    """Struct label, members and note of a printed place.

    A place is known by its compact() spelling, as are special labels. Two or more known places, divided by commas and
    perhaps inside wrapper (a pattern whose first group is the list), are several, with the sorted distinct places as members. A blank has an empty label. All
    else is unknown, with a note; a place under another spelling is noted as an alias.
    """
    known = F.create_map(*[F.lit(x) for k, v in places.items() for x in (k, v)])
    other = F.create_map(*[F.lit(x) for k, v in special.items() for x in (k, v)])
    text = F.trim(F.coalesce(raw, F.lit("")))
    one = F.try_element_at(known, compact(text))
    inside = F.regexp_extract(text, wrapper, 1)
    parts = F.filter(F.split(F.when(inside != "", inside).otherwise(text), ","), lambda p: F.trim(p) != "")
    named = F.transform(parts, lambda p: F.try_element_at(known, compact(p)))
    listed = (F.size(parts) > 1) & ~F.exists(named, lambda p: p.isNull())
    blank = compact(text) == ""
    special_label = F.try_element_at(other, compact(text))
    label = F.when(blank, "").otherwise(F.coalesce(one, special_label, F.when(listed, F.lit(several)).otherwise(F.lit(unknown))))
    told = one.isNotNull() | special_label.isNotNull()
    members = F.when(~blank & ~told & listed, F.array_join(F.sort_array(F.array_distinct(named)), ";")).otherwise("")
    note = F.when(one.isNotNull() & (F.upper(text) != F.upper(one)), "alias").when(blank | told | listed, "").otherwise("unrecognised")
    return F.struct(label.alias("label"), members.alias("members"), note.alias("note"))


def shape(sector: Column, name: Column, linear: str, solid: str, sectors: tuple[str, ...], always: tuple[str, ...] = ()) -> Column:
    """Linear or Non-Linear. Sectors in always are linear; else a linear word in the name wins, then a non-linear one, then the sector."""
    text, kind = F.coalesce(name, F.lit("")), F.coalesce(sector, F.lit(""))
    line = text.rlike(linear) | kind.isin(*always)
    return F.when(line | (~text.rlike(solid) & kind.isin(*sectors)), "Linear").otherwise("Non-Linear")


def of_kind(sector: Column, name: Column, in_sector: str, in_name: str, linear: Column) -> Column:
    """Whether the sector is of a kind, or the name of something that is not a line says so (a line to a mine is no mine)."""
    return F.coalesce(sector, F.lit("")).rlike(in_sector) | (F.coalesce(name, F.lit("")).rlike(in_name) & ~linear)
