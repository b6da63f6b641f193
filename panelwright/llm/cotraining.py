"""Quality classifier by co-training two views of a document (operator 2).

The content view has the words of the text, hashed and in lower case, their shapes (runs of lower and upper case, digits and other
characters), how often words and lines repeat, and shares of character classes. The metadata view has what is known without reading:
source, language, length, and the layout in lines. Each view is a logistic regression. In each of ``rounds`` both views
are fitted and calibrated and score the whole pool, which is every document outside the labelled sample; each then hands
the other ``grow`` documents it is sure of, in the classes' proportions. Among the sure ones those with the lowest hash
are taken, so that they spread over all kinds of documents, and of equal documents only one. At last both are calibrated
on labelled rows that trained neither, and a document's score, the chance that it is good, is the logistic combination
of the calibrated views fitted on those rows.

Features are computed on executors and written once. What the driver collects is bounded by parameters: the features
(about 3 kB each) of ``n_labelled`` labelled documents, those with the lowest hashes of their ids, and of at most 2 x
``grow`` a round. A round is one pass over the features; all that is shuffled is the hashes of sure documents.
Scoring is one pass over the texts without a shuffle.

A null or empty text has no words and is scored by its zeros and its metadata; null metadata are values of their
own. Without labels of both classes the score is that of the only class, 1 without labels. Several labels of a document all
count. Equal documents have equal scores; a score that equals the threshold keeps. Columns of df other than the four
that are read do not matter, but those named as classify's results are replaced by them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, stored, text_udf

#: Buckets of word shapes, words, sources and languages.
SHAPES, WORDS, SOURCES, LANGUAGES = 192, 512, 48, 16
#: Words that a task keeps with their buckets, and the longest of them.
CACHED, CACHED_CHARS = 100_000, 32
#: Numbers of the content view's features and the metadata view's.
CONTENT, METADATA = SHAPES + 6 + WORDS, SOURCES + LANGUAGES + 4


def shape(word: str) -> str:
    """The word's kinds of characters, repeats dropped: 'Them,%%' is 'Aa,%'."""
    out = []
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class WordBuckets(dict):
    """Of a word, the bucket of its shape and that of the word as one number."""

    def __missing__(self, word: str) -> int:
        hashed = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))
        value = hashed(shape(word)) % SHAPES * WORDS + hashed(word.lower().strip(".,;:!?\"'()")) % WORDS
        if len(word) <= CACHED_CHARS:
            if len(self) > CACHED:
                self.clear()
            self[word] = value
        return value


def content_features(text: str | None, buckets: WordBuckets | None = None) -> np.ndarray:
    text, buckets = text or "", WordBuckets() if buckets is None else buckets
    words = text.split()
    out = np.zeros(CONTENT, np.float32)
    if not words:
        return out
    n = len(words)
    both = np.fromiter(map(buckets.__getitem__, words), np.int64, n)
    out[:SHAPES] = np.sqrt(np.bincount(both // WORDS, minlength=SHAPES) / n)
    out[SHAPES + 6 :] = np.sqrt(np.bincount(both % WORDS, minlength=WORDS) / n)
    lines = [x for x in text.split("\n") if x]
    out[SHAPES] = 1 - len(set(words)) / n
    out[SHAPES + 1] = 1 - len(set(lines)) / max(1, len(lines))
    out[SHAPES + 2] = (len(text) - len(words) + 1) / n / 10
    out[SHAPES + 3] = sum(map(text.count, "#*$%&|<>")) / n
    out[SHAPES + 4] = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / n if n > 2 else 0
    out[SHAPES + 5] = min(1.0, n / 50)
    return out


def metadata_features(source: str | None, lang: str | None, n_chars, n_lines) -> np.ndarray:
    out = np.zeros(METADATA, np.float32)
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode()) % LANGUAGES] = 1
    chars = 0.0 if n_chars is None or n_chars != n_chars else max(0.0, float(n_chars))
    lines = 0.0 if n_lines is None or n_lines != n_lines else max(0.0, float(n_lines))
    out[-4:] = np.log1p(chars) / 10, np.log1p(lines) / 5, np.log1p(chars / max(1.0, lines)) / 10, chars < 80
    return out


def _columns(df: DataFrame, text: str) -> list[Column]:
    """The four inputs of the views, n_lines counted from the text."""
    lines = F.length(text) - F.length(F.translate(F.col(text), "\n", "")) + 1
    return [F.col(text), F.col("source"), F.col("lang"), F.col("n_chars"), lines.alias("n_lines")]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the unpenalised intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class CoModel:
    """Weights and calibration (slope, intercept) of both views, and their combination; or one constant score."""

    views: list[np.ndarray] = field(default_factory=list)
    calibration: list[np.ndarray] = field(default_factory=list)
    combination: np.ndarray | None = None
    constant: float = 1.0

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chance of good by content, by metadata, and combined."""
        if self.combination is None:
            same = np.full(len(content), self.constant)
            return same, same, same
        z = [_logit(_logit(x, w)[:, None], c) for x, w, c in zip((content, metadata), self.views, self.calibration, strict=True)]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(_logit(np.column_stack(z), self.combination))


class Cotraining:
    """Both views' rows to learn from, growing by what the other view hands over."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, held: np.ndarray, penalty: float):
        self.held, self.held_y, self.penalty = [v[held] for v in views], y[held], penalty
        self.x, self.y = [[v[~held]] for v in views], [[y[~held]] for _ in views]
        self.known = len(set(y[~held])) == 2 and len(set(y[held])) == 2
        self.good = float(np.mean(y[~held])) if self.known else 0.5

    def fitted(self) -> CoModel:
        """Both views fitted and calibrated as they stand; the combination is fitted on held-back rows."""
        views = [fit_logistic(np.concatenate(x), np.concatenate(y), self.penalty) for x, y in zip(self.x, self.y, strict=True)]
        calibration = [fit_logistic(_logit(h, w)[:, None], self.held_y, 1e-3) for h, w in zip(self.held, views, strict=True)]
        z = np.column_stack([_logit(_logit(h, w)[:, None], c) for h, w, c in zip(self.held, views, calibration, strict=True)])
        return CoModel(views, calibration, fit_logistic(z, self.held_y, 1e-2))

    def hand_over(self, view: int, rows: list[bytes], label: float) -> None:
        """Rows (both views' features each) that a view is sure of, to the other view."""
        if rows:
            self.x[1 - view].append(split(rows)[1 - view])
            self.y[1 - view].append(np.full(len(rows), label))


def split(rows: list[bytes]) -> list[np.ndarray]:
    """Both views' features of packed rows."""
    x = np.array([np.frombuffer(r, np.float32) for r in rows]).reshape(-1, CONTENT + METADATA)
    return [x[:, :CONTENT], x[:, CONTENT:]]


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, h (a hash of all that is read of the document) and x, both views' features."""

    def prepare():
        buckets = WordBuckets()
        one = lambda t, *m: np.concatenate([content_features(t, buckets), metadata_features(*m)]).tobytes()
        return lambda *columns: [one(*row) for row in zip(*columns, strict=True)]

    return docs.select("doc_id", F.xxhash64(text, "source", "lang", "n_chars").alias("h"), text_udf("binary", prepare)(*_columns(docs, text)).alias("x"))


def sure_rows(pool: DataFrame, model: CoModel, sure: float, most: dict[tuple[int, int], int], taken: set[int]) -> dict[tuple[int, int], list[bytes]]:
    """Features of the pool's documents that a view gives a label with a chance of at least sure, by view and label: at
    most so many of each, those with the lowest h, one of each h and none of those taken before, which are added."""

    def prepare():
        return lambda rows: [{"c": float(c), "m": float(m)} for c, m in zip(*model.scores(*split(rows))[:2], strict=True)]

    spark = pool.sparkSession
    gone = spark.createDataFrame([(h,) for h in taken], "h long")
    scored = pool.join(F.broadcast(gone), "h", "left_anti").select("h", text_udf("struct<c:double,m:double>", prepare)("x").alias("p"))
    kinds = [(v, label) for v in (0, 1) for label in (0, 1)]
    chance = {(v, label): F.col(f"p.{'cm'[v]}") if label else 1 - F.col(f"p.{'cm'[v]}") for v, label in kinds}
    kind = F.explode(F.array_compact(F.array(*[F.when(chance[k] >= sure, F.lit(i)) for i, k in enumerate(kinds)])))
    limit = F.element_at(F.array(*[F.lit(most[k]) for k in kinds]), F.col("kind") + 1)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
    rows = cut(scored.select("h", kind.alias("kind")).distinct())
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # Hashes are even over their range: those below share have some four times as many as are taken, however many tasks
    # there are. Should they be too few, all are ordered.
    share = [min(1.0, (4 * most[k] + 100) / counts.get(i, 1)) for i, k in enumerate(kinds)]
    low = rows.where(F.col("h") / 2.0**64 + 0.5 <= F.element_at(F.array(*map(F.lit, share)), F.col("kind") + 1))
    below = {r["kind"]: r["n"] for r in low.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    enough = all(below.get(i, 0) >= min(most[kinds[i]], n) for i, n in counts.items())
    chosen = (low if enough else rows).withColumn("n", place).where(F.col("n") <= max(most.values())).where(F.col("n") <= limit)
    found = [(r["h"], r["kind"]) for r in chosen.select("h", "kind").collect()]
    taken.update(h for h, _ in found)
    wanted = spark.createDataFrame(found, "h long, kind int")
    features = pool.join(F.broadcast(wanted), "h").groupBy("kind", "h").agg(F.min("x").alias("x")).collect() if found else []
    out: dict[tuple[int, int], list[bytes]] = {k: [] for k in kinds}
    for row in sorted(features, key=lambda r: (r["kind"], r["h"])):
        out[kinds[row["kind"]]].append(row["x"])
    return out


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """packed() of docs, written once: what train() learns from and score_features() scores."""
    return stored(packed(docs, text))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> CoModel:
    """The model from docs (doc_id, text, source, lang, n_chars) and labels (doc_id, quality 0 or 1); options as train_on() has them."""
    return train_on(features(docs, text), labels, **options)


def train_on(every: DataFrame, labels: DataFrame, n_labelled: int = 3000, seed: int = 2, rounds: int = 4, grow: int = 250, sure: float = 0.95, penalty: float = 1.0) -> CoModel:
    """The model from the features of documents."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    below = int(min(1.0, n_labelled / max(1, known.count())) * (1 << 30))
    chosen = known.where(chance < below).select("doc_id", "quality", (chance % 3 == 0).alias("held"))
    rows = every.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "held", "x").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["quality"], bytes(r["x"])))
    y = np.array([float(r["quality"] > 0) for r in rows])
    learner = Cotraining(split([r["x"] for r in rows]), y, np.array([bool(r["held"]) for r in rows], bool), penalty)
    if not learner.known:
        return CoModel(constant=float(np.mean(y)) if len(y) else 1.0)
    pool = every.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_anti")
    most = {(v, label): max(1, round(grow * (learner.good if label else 1 - learner.good))) for v in (0, 1) for label in (0, 1)}
    taken: set[int] = set()
    for _ in range(rounds):
        handed = sure_rows(pool, learner.fitted(), sure, most, taken)
        for (view, label), found in handed.items():
            learner.hand_over(view, found, float(label))
        if not any(handed.values()):
            break
    return learner.fitted()


def score_features(every: DataFrame, model: CoModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_content, p_metadata, score and kept of the documents of features(), without reading their texts again."""

    def prepare():
        return lambda rows: [dict(zip(("p_content", "p_metadata", "score"), map(float, p), strict=True)) for p in zip(*model.scores(*split(rows)), strict=True)]

    found = every.select("doc_id", text_udf("struct<p_content:double,p_metadata:double,score:double>", prepare)("x").alias("p"))
    return found.select("doc_id", "p.*", (F.col("p.score") >= threshold).alias("kept"))


def chances(docs: DataFrame, model: CoModel, text: str = "text") -> Column:
    """A struct of p_content, p_metadata and score for each row of docs."""

    def prepare():
        buckets = WordBuckets()

        def scored(texts, *others):
            content = np.array([content_features(t, buckets) for t in texts]).reshape(-1, CONTENT)
            metadata = np.array([metadata_features(*r) for r in zip(*others, strict=True)]).reshape(-1, METADATA)
            return [dict(zip(("p_content", "p_metadata", "score"), map(float, p), strict=True)) for p in zip(*model.scores(content, metadata), strict=True)]

        return scored

    return text_udf("struct<p_content:double,p_metadata:double,score:double>", prepare)(*_columns(docs, text))


def classify(df: DataFrame, model: CoModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """df with p_content, p_metadata, score and kept (score at least threshold)."""
    names = ("p_content", "p_metadata", "score")
    found = df.drop(*names, "kept").withColumn("_found", chances(df, model, text))
    return found.withColumns({n: F.col(f"_found.{n}") for n in names} | {"kept": F.col("_found.score") >= threshold}).drop("_found")
