"""Language identification with hyperdimensional profiles (operator 6).

Every letter has a random vector of +1 and -1, drawn from its code point, so any alphabet is covered. A
trigram is bound from its letters' vectors, rotated by two, one and no places and multiplied; a text is
the bundle (the sum over its trigrams) and so is a language, over its training texts scaled to one
length. A text has the language of the nearest prototype by cosine, and that cosine, at least 0, is its score.

Training bundles a bounded sample: at most about ``per_language`` texts of each language, those whose
hash is lowest, so rare languages are all used. Texts become vectors in the tasks that read them, and a task's
vectors of a language are one sum, added up by Spark place by place. The prototypes (languages x DIMENSIONS)
are all that reaches the driver. Prediction is one pass without a shuffle.

A null text, or one without letters, is ``und`` with score 0, and so is every text when nothing was
learned. Text is lower-cased; letters are the Unicode categories L, marks (M) belong to the letter before them, and anything else
separates words. Ties go to the language first in order. Equal texts have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, steps, text_udf
from panelwright.sources.session import ship

UNDETERMINED = "und"
DIMENSIONS = 1024
#: Trigram vectors that a task keeps before it starts afresh; 1 kB each.
CACHED = 20_000
#: Languages up to which their shares, about 32 bytes each, are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_LANGUAGES = 10_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Encoder:
    """Bundles texts; letter and trigram vectors are made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 6):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def _rows(self, trigrams: list[int]) -> list[int]:
        if len(self.place) + len(trigrams) > max(CACHED, len(trigrams)):
            self.forget()
        rows = []
        for t in trigrams:
            row = self.place.get(t)
            if row is None:
                row = self.place[t] = len(self.place)
                if row == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                a, b, c = t >> 42, t >> 21 & 0x1FFFFF, t & 0x1FFFFF
                self.vectors[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            rows.append(row)
        return rows

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the text's trigram vectors, or None without letters."""
        letters = " ".join(_WORD.findall((text or "").lower()))
        if not letters:
            return None
        codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        found, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(found), 4096):
            rows = self._rows(found[at : at + 4096].tolist())
            total += counts[at : at + 4096].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


def sample(labelled: DataFrame, per_language: int, seed: int = 6) -> DataFrame:
    """About per_language rows of each language (doc_id, text, lang), those whose hash is lowest."""
    share = cut(labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share")))
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(share, "lang").where(chance < F.col("share")).select("lang", "text")


def train(labelled: DataFrame, per_language: int = 1000) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from rows of doc_id, text and lang; rows without a language teach nothing."""
    known = labelled.where(F.col("lang").isNotNull())

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, n in steps(batch.column("text")):
                part = batch.slice(at, n)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    vector = encoder.bundle(text)
                    if vector is not None:
                        total[lang] = total.get(lang, 0) + vector / np.linalg.norm(vector)
        vectors = pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), vectors], ["lang", "vector"])

    ship(labelled.sparkSession)
    at, value = F.posexplode("vector").alias("at", "value"), F.sum("value").alias("value")
    sums = sample(known, per_language).mapInArrow(bundles, "lang string, vector array<double>").select("lang", at).groupBy("lang", "at").agg(value)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    rows = sums.groupBy("lang").agg(ordered.alias("vector")).collect()
    out = {}
    for row in sorted(rows, key=lambda r: r["lang"]):
        vector = np.asarray(row["vector"], np.float32)
        out[row["lang"]] = vector / max(float(np.linalg.norm(vector)), 1e-9)
    return out


def predict(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """A struct of lang_pred and score for the text column."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else None

    def prepare():
        encoder = Encoder()

        def nearest(text: str | None) -> dict:
            vector = encoder.bundle(text) if names else None
            norm = 0.0 if vector is None else float(np.linalg.norm(vector))
            if not norm:
                return {"lang_pred": UNDETERMINED if vector is None else names[0], "score": 0.0}
            cosines = matrix @ vector / norm
            best = int(np.argmax(cosines))
            return {"lang_pred": names[best], "score": min(1.0, max(0.0, float(cosines[best])))}

        return lambda texts: [nearest(t) for t in texts]

    return text_udf("struct<lang_pred:string,score:double>", prepare)(text)
