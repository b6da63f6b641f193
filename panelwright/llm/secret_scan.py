"""Secret scans: fixed patterns, and character Markov models of random strings (operator 4).

``PATTERNS`` find keyed assignments, access key ids and long hexadecimal runs. Beside them, every long
run of key characters is scored by two first-order character Markov models, one of random strings and
one of ordinary identifiers; the mean log-likelihood ratio a character decides. Both are estimated from
labelled samples: transition counts are a Spark aggregation of at most labels x alphabet^2 rows, which
is all that reaches the driver.

Scanning is one pass without a shuffle. Spans are code point offsets, end exclusive. Spans of a pattern
stay whatever the models say, and the models only add spans that overlap none of them.

Null and empty texts have no spans. Texts are scanned whole. Without a sample of some label, its model
is uniform over the alphabet.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import let, text_udf

#: Kind, pattern, group whose length counts, least length; in the order of report.
PATTERNS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    ("hex", r"[0-9a-f]+", 0, 0, 32),
)
KINDS = tuple(p[0] for p in PATTERNS) + ("markov",)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
#: Sources and languages up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: A pattern matches only where one of these stands in the text, its A-Z lowered if the first is true.
NEEDS = {"assign": (True, (b"passw", b"secret", b"token", b"apikey", b"api_key")), "access": (False, (b"AKIA",)), "hex": (False, ())}


#: Share of the uniform distribution in each transition's chance: a transition that no ordinary sample has, as between
#: rare words, weighs a few bits and not many.
UNSEEN = 0.2


class MarkovPair:
    """Log2 ratio of transition probabilities, random over ordinary, each mixed with the uniform distribution."""

    def __init__(self, counts: dict[tuple[str, str, int], int], min_length: int = 20, min_bits: float = 0.5):
        size = len(ALPHABET)
        place = {c: i for i, c in enumerate(ALPHABET)}
        tables = np.zeros((2, size, size))
        for (a, b, label), n in counts.items():
            tables[label, place[a], place[b]] += n
        total = tables.sum(axis=2, keepdims=True)
        chance = UNSEEN / size + (1 - UNSEEN) * np.where(total > 0, tables / np.maximum(total, 1), 1 / size)
        self.ratio = np.log2(chance[1]) - np.log2(chance[0])
        self.codes = np.zeros(128, np.int64)
        for c, i in place.items():
            self.codes[ord(c)] = i
        self.min_length, self.min_bits = min_length, min_bits

    def bits(self, run: str) -> float:
        """Mean log-likelihood ratio of the run's transitions; 0 for fewer than two characters."""
        codes = self.codes[np.frombuffer(run.encode("ascii"), np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def is_random(self, run: str) -> bool:
        letters = re.search("[A-Za-z]", run)
        return bool(letters) and len(run) >= self.min_length and self.bits(run) >= self.min_bits


def transition_counts(samples: DataFrame) -> DataFrame:
    """Counts of adjacent characters of samples (text, label 0 or 1), characters outside ALPHABET breaking runs."""
    size = F.length("text")
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr("text", i, F.lit(2)))
    return (
        samples.where(size > 1)
        .select("label", F.explode(pairs).alias("pair"))
        .groupBy("pair", "label")
        .count()
        .where(F.col("pair").rlike(f"^{RUN}{{2}}$"))
    )


def train(samples: DataFrame, **limits) -> MarkovPair:
    """The two models from labelled samples: text, label (1 random, 0 ordinary)."""
    counts = {(r["pair"][0], r["pair"][1], int(r["label"])): r["count"] for r in transition_counts(samples).collect()}
    return MarkovPair(counts, **limits)


def default_samples(docs: DataFrame, n_docs: int = 500, n_random: int = 4000, seed: int = 17) -> DataFrame:
    """Labelled samples: digests in hexadecimal and base 64, and identifiers made of a bounded sample's words.

    About n_docs documents give the ordinary words (2 to 19 key characters): of each source and language its share, one at least,
    those whose hash is lowest; neighbours joined in snake, kebab, path and camel case, in capitals and with a number give
    compound identifiers.
    """
    spark = docs.sparkSession
    total = max(1, docs.count())
    kinds = [F.col(c) for c in ("source", "lang") if c in docs.columns]
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    below = chance < math.ceil(1e6 * min(1.0, n_docs / total))
    # The lowest hash of a kind keeps one of its documents where none is below the share.
    least = docs.groupBy(F.struct(*kinds).alias("_kind") if kinds else F.lit(0).alias("_kind")).agg(F.min(chance).alias("_least"))
    drawn = docs.withColumn("_kind", F.struct(*kinds) if kinds else F.lit(0))
    near = drawn.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, drawn["_kind"].eqNullSafe(least["_kind"]), "left").where(below | (chance == F.col("_least")))
    words = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{RUN}+"), F.lit(0)), lambda w: F.length(w).between(2, 19))
    triples = let(words, lambda w: F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.slice(w, i, 3))))
    triples = near.select(F.explode(triples).alias("w"))
    camel = F.array_join(F.transform("w", lambda x: F.initcap(x)), "")
    snake = F.array_join("w", "_")
    versioned = F.concat(F.array_join(F.slice("w", 1, 2), "-"), F.lit("-"), F.length(camel).cast("string"))
    forms = F.array(F.element_at("w", 1), snake, F.upper(snake), F.array_join("w", "-"), F.array_join("w", "/"), camel, F.upper(camel), versioned)
    ordinary = triples.select(F.explode(forms).alias("text"), F.lit(0).alias("label"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")), 256)
    code = F.base64(F.unhex(digest))
    forms = F.array(digest, code, F.translate(code, "+/=", ""), F.translate(code, "+/=", "-_"), F.upper(F.translate(code, "+/=", "")))
    random = spark.range(n_random).select(F.explode(forms).alias("text"), F.lit(1).alias("label"))
    return ordinary.unionByName(random)


def find_patterns(text: str, compiled) -> list[tuple[int, int, int]]:
    """Spans (start, place in KINDS, end) of the patterns: leftmost, not overlapping within a kind."""
    found, data = [], text.encode()
    lowered = data.lower()
    for place, (kind, pattern, group, least) in enumerate(compiled):
        lower, needed = NEEDS[kind]
        if needed and not any(x in (lowered if lower else data) for x in needed):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), place, m.end()))
    return found


def find_spans(text: str, compiled, long_run, models: MarkovPair | None) -> list[tuple[int, int, int]]:
    """Spans of the patterns and, where none of them lies, of random runs: one walk through both in order."""
    found = find_patterns(text, compiled)
    if models is not None:
        base, at = sorted((a, b) for a, _, b in found), 0
        covered = -1
        for m in long_run.finditer(text):
            while at < len(base) and base[at][0] < m.end():
                covered = max(covered, base[at][1])
                at += 1
            if covered <= m.start() and models.is_random(m.group()):
                found.append((m.start(), len(KINDS) - 1, m.end()))
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _compile(models: MarkovPair | None):
    #: A run of hexadecimal digits shorter than the least can be passed over without changing the matches.
    compiled = [(k, re.compile(p if k != "hex" else f"[0-9a-f]{{{least},}}", flags), group, least) for k, p, flags, group, least in PATTERNS]
    return compiled, re.compile(f"{RUN}{{{models.min_length if models else 20},}}")


def scan(text: Column, models: MarkovPair | None) -> Column:
    """Spans of secrets in text: an array of kind, start, end, by start and then by kind as in KINDS."""

    def prepare():
        compiled, long_run = _compile(models)
        spans = lambda t: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t or "", compiled, long_run, models)]
        return lambda texts: [spans(t) for t in texts]

    return text_udf("array<struct<kind:string,start:long,end:long>>", prepare)(text)


def clean(text: Column, models: MarkovPair | None, mark: str = "[secret]") -> Column:
    """text with its secrets replaced by mark; null stays null."""

    def prepare():
        compiled, long_run = _compile(models)
        return lambda texts: [None if t is None else redact(t, find_spans(t, compiled, long_run, models), mark) for t in texts]

    return text_udf("string", prepare)(text)
