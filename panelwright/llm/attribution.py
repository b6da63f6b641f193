"""Token counts by section, from one encoding of each whole document (operator 8).

A document is encoded once. Its tokens' byte lengths give their character spans: a token that starts
or ends inside a character covers that whole character. The spans are interval-joined to the
document's sections, and RULES says which section a boundary-crossing token belongs to:

* ``first``: the section of its first character;
* ``last``: the section of its last character;
* ``most``: the section that holds most of its characters, the earlier of equals;
* ``share``: each section it touches, in proportion to the characters there.

Sections are given as consecutive sizes, so the interval join is two binary searches in their sorted
ends, inside the row: no shuffle, and no pair of a token with a section it does not touch.

Null and empty texts have no section and no tokens. A text of one line is one section. Equal rows have equal counts. Columns
named section_sizes, tokens, whole_text and field_names are replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import let, text_udf

RULES = ("first", "last", "most", "share")


def _encoding(path: str, pattern: str):
    return _encoding_of(Path(path).read_bytes(), pattern)


@lru_cache(maxsize=2)
def _encoding_of(rank_file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for data, rank in ranks.items():
        lengths[rank] = len(data)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, rank_file: bytes, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of the text's tokens."""
    encoding, lengths = _encoding_of(rank_file, pattern)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    if not len(ids):
        return ends, ends
    return char[ends - lengths[ids]], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section under the rule; they add up to the number of tokens."""
    n = len(section_ends)
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, ends - 1, "right")
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float)
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(float)
    begins = np.concatenate([[0], section_ends[:-1]])
    for i in np.flatnonzero(~inside):
        touched = np.arange(first[i], last[i] + 1)
        held = np.minimum(section_ends[touched], ends[i]) - np.maximum(begins[touched], starts[i])
        if rule == "most":
            counts[touched[np.argmax(held)]] += 1
        else:
            counts[touched] += held / held.sum()
    return counts


def line_sizes(text: Column) -> Column:
    """Code points of each line of text, with its newline; none for a null or empty text."""
    sizes = lambda lines: F.transform(lines, lambda line, i: F.length(line).cast("long") + (i < F.size(lines) - 1).cast("long"))
    return F.when(text != "", F.filter(let(F.split(text, "\n"), sizes), lambda n: n > 0)).otherwise(F.array().cast("array<long>"))


def counter(path: str, pattern: str, rule: str = "first"):
    """A UDF (text, section sizes) -> struct of the token total, crossings and counts. The rank file, under 1 MB, goes with the code: executors
    need no copy of it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    rank_file = Path(path).read_bytes()

    def prepare():
        def count(text: str | None, sizes: list[int] | None) -> dict:
            if not text or not sizes:
                return {"n_tokens": 0, "n_crossing": 0, "counts": [0.0] * len(sizes or [])}
            a, b = token_spans(text, rank_file, pattern)
            e = np.cumsum(np.asarray(sizes, np.int64))
            crossing = int((np.searchsorted(e, a, "right") != np.searchsorted(e, b - 1, "right")).sum())
            return {"n_tokens": len(a), "n_crossing": crossing, "counts": attribute(a, b, e, rule)}

        return lambda texts, sections: [count(*row) for row in zip(texts, sections, strict=True)]

    return text_udf("struct<n_tokens:long,n_crossing:long,counts:array<double>>", prepare)


def by_section(df: DataFrame, path: str, pattern: str, rule: str = "first", text: str = "text", sizes: Column | None = None) -> DataFrame:
    """df with ``section_sizes`` and ``tokens``: n_tokens, n_crossing and counts, one number a section.

    The sizes must add up to the text's code points; by default each line is a section.
    """
    sizes = line_sizes(F.col(text)) if sizes is None else sizes
    return df.withColumn("section_sizes", sizes).withColumn("tokens", counter(path, pattern, rule)(F.col(text), F.col("section_sizes")))


def by_field(df: DataFrame, fields: list[str], path: str, pattern: str, rule: str = "first", separator: str = "\n") -> DataFrame:
    """Token counts of fields written as one text, joined by separator (it belongs to the field before it)."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    last = len(parts) - 1
    sizes = F.array(*[F.length(p).cast("long") + F.lit(len(separator) if i < last else 0) for i, p in enumerate(parts)])
    joined = df.withColumn("whole_text", F.concat_ws(separator, *parts))
    return by_section(joined, path, pattern, rule, "whole_text", sizes).withColumn("field_names", F.array(*map(F.lit, fields)))
