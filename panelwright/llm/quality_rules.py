"""Quality rules as learned decision lists (operator 3), on DataFrame functions only.

``statistics`` measures every text in one projection without a shuffle. A text is rejected outright when it
fails the base rule; the others are judged by an ordered list of threshold conjunctions, learned by
sequential covering from labelled statistics: a rule for bad texts grows one threshold at a time, by
information gain, over candidate thresholds at quantiles, is pruned on held-back rows, and the rows it
covers are set aside before the next rule grows. Each step is one aggregation of the labelled
rows, so only counts reach the driver. The list is emitted as one CASE expression.

Learning may use a bounded sample: labelled documents with the lowest hashes of their ids, at most
about ``MAX_LABELLED`` (their ids are broadcast, at most 16 bytes each). Null and empty texts have zero
statistics and fail the base rule. Without labels, or without bad ones, the list is empty and only the base rule
rejects. Conflicting labels of one document all count. Among equal gains, the first
feature's middle threshold wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import SPACE, cut, let, words

#: Fixed values of the base rule and its counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

MAX_LABELLED = 8_000
#: Partitions of the labelled rows, which are bounded.
PARTS = 6
#: Measures that rules may test.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "line_words")


def _repeated_words(tokens: Column) -> Column:
    """Words in windows of WINDOW words that occur at least twice: windows are hashed, sorted with their places and
    compared with their neighbours; the places found, in order, cover up to WINDOW words each."""
    keys = let(tokens, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.struct(F.xxhash64(F.slice(w, i, WINDOW)).alias("h"), i.alias("i"))))

    def twice(sorted_keys: Column) -> Column:
        same = lambda a, b: a["h"] == b["h"]
        return F.transform(
            F.filter(sorted_keys, lambda k, j: F.coalesce(same(k, F.get(sorted_keys, j - 1)), F.lit(False)) | F.coalesce(same(k, F.get(sorted_keys, j + 1)), F.lit(False))),
            lambda k: k["i"],
        )

    def covered(places: Column) -> Column:
        gap = lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, n: a + n)

    found = let(F.array_sort(keys), twice)
    return F.when(F.size(tokens) < WINDOW + 1, F.lit(0)).otherwise(let(F.array_sort(found), covered))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), the features and base_failed."""
    full = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.length(F.translate(x, " \t\n\u000b\u000c\r", "")) > 0)
    raw = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(full, " \t\n\u000b\u000c\r", "")).cast("long").alias("word_chars"),
            (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            (F.length(full) - F.length(F.regexp_replace(full, "[A-Z]", ""))).alias("n_upper"),
        ),
    )
    out = df.withColumn("_raw", raw)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = out.withColumns({n: F.col(f"_raw.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_repeat_words")} | {"n_dup_lines": F.col("_raw.lines.dup").cast("long")})
    return out.withColumns(
        {
            "word_length": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "_raw.lines.n"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("_raw.n_upper", "word_chars"),
            "line_words": share("n_words", "_raw.lines.n"),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        }
    ).drop("_raw")


@dataclass(frozen=True)
class Test:
    """One threshold: feature above (or at most) value."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:g}"


Rule = tuple[Test, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


def _counts(rows: DataFrame, conditions: list[Column]) -> list[tuple[int, int]]:
    """Bad and good rows that each of a few conditions covers, in one aggregation."""
    sums = [F.count_if(c & (F.col("bad") == b)) for c in conditions for b in (1, 0)]
    row = rows.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(conditions))]


def _candidate_counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[Test, tuple[int, int]]:
    """Bad and good rows that each candidate covers: one count by feature and bin, summed up over the bins.

    rows has the features' bins, ``bin_`` and the feature's name: the number of its thresholds below the value.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("bin")) for f in thresholds]))
    found = rows.select("bad", stacked.alias("s")).groupBy("s.f", "s.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    out = {}
    for f, values in thresholds.items():
        bins = {r["bin"]: (r["bad"], r["n"] - r["bad"]) for r in found if r["f"] == f}
        total = tuple(sum(x[k] for x in bins.values()) for k in (0, 1))
        below = [0, 0]
        for i, value in enumerate(values):
            below = [below[k] + bins.get(i, (0, 0))[k] for k in (0, 1)]
            out[Test(f, False, value)] = (below[0], below[1])
            out[Test(f, True, value)] = (total[0] - below[0], total[1] - below[1])
    return out


def _gain(bad: int, good: int, before: tuple[int, int]) -> float:
    """Information gain of covering bad and good of the rows covered before."""
    if not bad:
        return 0.0
    bits = lambda b, g: -math.log2((b + 1e-9) / (b + g + 1e-9))
    return bad * (bits(*before) - bits(bad, good))


def _thresholds(values: list[float]) -> list[float]:
    """The values and, for thresholds with a margin, the points midway between neighbours."""
    values = sorted({float(v) for v in values})
    return sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:], strict=False))})


def learn(rows: DataFrame, features: tuple[str, ...] = FEATURES, n_thresholds: int = 16, max_rules: int = 8, max_tests: int = 3, least_cover: int = 5, precision: float = 0.9) -> list[Rule]:
    """An ordered list of rules for bad rows, from rows with the features and bad (0 or 1).

    A third of the rows (column ``prune``, true there) is held back: a rule keeps only as many of its first tests as do
    best there, and the list ends when a rule's share of bad rows there is below precision.
    """
    rows = cut(rows.select(*features, "bad", "prune").repartition(PARTS))
    at = [i / n_thresholds for i in range(n_thresholds + 1)]
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in features]).collect()
    thresholds = {f: _thresholds([v for row in cuts for v in row[f] or []]) for f in features}
    below = lambda f: lambda t: t < F.col(f)
    bins = {f"bin_{f}": F.size(F.filter(F.array(*map(F.lit, v)), below(f))) if v else F.lit(0) for f, v in thresholds.items()}
    rows = cut(rows.withColumns(bins))
    grow, prune = rows.where(~F.col("prune")), rows.where(F.col("prune"))
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        covered = _counts(grow.where(left), [F.lit(True)])[0]
        while len(rule) < max_tests and covered[0] and covered[1]:
            counts = _candidate_counts(grow.where(left & holds(rule)), thresholds)
            gains = {t: _gain(b, g, covered) if b >= least_cover else 0.0 for t, (b, g) in counts.items()}
            most = max(gains.values(), default=0.0)
            if most <= 1e-9:
                break
            equal = [t for t, g in gains.items() if g == most]
            equal = sorted((t for t in equal if (t.feature, t.above) == (equal[0].feature, equal[0].above)), key=lambda t: t.value)
            best = equal[len(equal) // 2]
            rule, covered = (*rule, best), counts[best]
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        worth = [((b - g) / (b + g) if b + g else -1.0, b, g) for b, g in _counts(prune.where(left), [holds(p) for p in prefixes])]
        best = max(range(len(prefixes)), key=lambda i: (worth[i][0], worth[i][1]))
        _, bad, good = worth[best]
        if not bad or bad < precision * (bad + good):
            break
        rules.append(prefixes[best])
        left = left & ~holds(prefixes[best])
    return rules


def first_rule(rules: list[Rule]) -> Column:
    """Place from 1 of the first rule that holds, 0 if none does: one ordered CASE."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(holds(rule), F.lit(i)) if out is None else out.when(holds(rule), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_statistics(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, seed: int = 3) -> DataFrame:
    """Statistics of at most about limit labelled documents (doc_id, text; doc_id, quality), with bad and prune."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = min(1.0, limit / max(1, known.count()))
    chosen = known.where(chance < int(share * (1 << 30))).select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"), (chance % 3 == 0).alias("prune"))
    measured = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # Written before it is filtered: the filter reads only the text and would move below the join, to all documents.
    return cut(measured.select(*FEATURES, "bad", "prune", "base_failed")).where(~F.col("base_failed"))


def judge(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """df with its statistics, rule (0: none, else the place of the rule that rejects) and kept."""
    measured = statistics(df, text).withColumn("rule", first_rule(rules))
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
