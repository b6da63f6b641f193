"""Exact Jaccard self-join of word shingle sets with PartEnum signatures (operator 9).

Two documents link when the Jaccard likeness of their sets of five-word shingles is at least 4/5. Sets fall into size
bands; a linked pair lies in one band or in neighbours, and is found in the smaller one's band. A
band cuts the shingle domain into ``n`` parts by hash, and a set's signature for a part is the hash
of its shingles there. Linked sets of sizes a <= b differ in at most k = (a + b) / 9 shingles, so at most k parts
differ and all but k of a set's parts agree. In any common order of signatures, then, the first k + 1 of both sets
share one, so each set emits its first k + 1, enough for every size it can link with; those with the
most shingles come first, as the least likely to agree by chance. A set with at most k parts that are not
empty might be missed; the domain is then cut anew with another seed, until no set is short every time.
Bands of small sets give each shingle its own part, larger ones have parts enough that none is short in practice.

Signatures of up to FEW sets propose their pairs, and a pair that shares too few signatures for its sizes is
dropped; larger signatures propose pairs with their smallest document. Proposed pairs are compared exactly, on whole
sets: each set with its likeliest partner first, then with those outside its component. What remains are large
signatures whose documents lie in several components: there documents must also share one of their rarest
shingles (a set's rarest fifth and one more: two linked sets share one of those), so frequent passages
propose nothing. Equal sets are found by a 128-bit key; one of them is compared.

Sets are 64-bit hashes of shingles. Null or empty texts, or texts of white space, have no shingle and link with
nothing. Rows of one id are one node; each row reports its own set's size. Rows with a null id link with nothing and
have a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, steps, stored
from panelwright.llm.components import extended
from panelwright.sources.session import ship

WORDS = 5
#: Links need NUM / DEN of the union in the intersection.
NUM, DEN = 4, 5
#: Signatures with up to so many documents propose all their pairs.
FEW = 12
#: Rows up to which ids and pairs (about 32 bytes each) are broadcast to the scan of texts; beyond, Spark joins.
BROADCAST_ROWS = 1_000_000
#: One document in so many is looked at for signatures that many share, HOT of them at least; their rows, as those of the sets
#: that are short, are dealt over SALTS tasks. This says where rows go, not what becomes of them.
LOOKED_AT, HOT, SALTS = 64, 32, 256
#: Set keys a task remembers, so that copies within it emit their signatures once.
REMEMBERED = 200_000
SHORT = -(1 << 62)

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def _mix(x: np.ndarray) -> np.ndarray:
    a, b, r = _MIX
    x = (x ^ (x >> r)) * a
    x = (x ^ (x >> r)) * b
    return x ^ (x >> r)


#: A 64-bit value of every byte, A-Z as a-z, and which bytes are white space.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd base and its inverse modulo 2**64; a word's hash is the polynomial of its bytes' values.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time, so that long texts take no more memory than this asks for.
BLOCK = 1 << 20


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, in order."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
    starts, ends = edges[0::2], edges[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        first, last = starts[at], ends[upto - 1]
        size = 1 << max(12, int(last - first).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[first:last]] * _powers(_BASE, size)[: last - first])])
        a, b = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = (sums[b] - sums[a]) * _powers(_INVERSE, size)[a]
        at = upto
    return _mix(out)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z are lowered."""
    w = word_hashes(np.frombuffer((text or "").encode(), np.uint8))
    if not len(w):
        return w
    if len(w) < WORDS:
        return _mix((w * _STEP[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - WORDS + 1
    h = w[:n] * _STEP[0]
    for j in range(1, WORDS):
        h += w[j : j + n] * _STEP[j]
    return np.unique(_mix(h))


@lru_cache(maxsize=1)
def band_edges() -> np.ndarray:
    """Smallest set size of each band: each over 25/16 times the one before."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 25 // 16 + 1)
    return np.array(edges)


def parts(band: int) -> int:
    """Parts into which a band cuts the domain."""
    largest = int(band_edges()[band + 1]) - 1
    return 1 << 32 if largest < 18 else largest * 34 // 100 + 12


def signatures(found: np.ndarray, seed: int) -> tuple[np.ndarray, bool]:
    """A set's signatures, and whether it has too few parts to be sure of every link."""
    m, edges = len(found), band_edges()
    band = int(np.searchsorted(edges, m, "right")) - 1
    k = (m + m * DEN // NUM) // 9
    bands = [band, band - 1] if band and NUM * m <= DEN * (int(edges[band]) - 1) else [band]
    if seed:
        found = np.sort(_mix(found + np.uint64(seed) * _STEP[1]))
    top, content, out, short = found >> np.uint64(32), _mix(found ^ _STEP[2]), [], False
    for b in bands:
        part = top * np.uint64(parts(b)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        short |= b == band and len(starts) <= k
        sigs = _mix(np.add.reduceat(content, starts) + part[starts] * _STEP[3] + _STEP[4:] * np.uint64(b + 1) + np.uint64(seed))
        fullest = np.lexsort((sigs, starts - np.append(starts[1:], m)))
        out.append(sigs[fullest[: k + 1]])
    return np.concatenate(out), short


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _per_text(df: DataFrame, make, schema: str) -> DataFrame:
    """df's rows through make(texts, other columns) in small steps; the last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for at, n in steps(batch.columns[-1]):
                part = batch.slice(at, n)
                yield make([shingles(t) for t in part.columns[-1].to_pylist()], part.columns[:-1], state)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def sizes(docs: DataFrame) -> DataFrame:
    """id, n_shingles and the set's key (k1, k2) of docs (id, text)."""

    def make(sets, columns, _):
        k1 = [int(_mix(s).sum()) & (1 << 64) - 1 for s in sets]
        k2 = [int(_mix(s ^ _STEP[0]).sum()) & (1 << 64) - 1 for s in sets]
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in sets], pa.int64()), _long(k1), _long(k2)], ["id", "n_shingles", "k1", "k2"])

    return _per_text(docs.select("id", "text"), make, "id long, n_shingles long, k1 long, k2 long")


def signed(docs: DataFrame, seed: int) -> DataFrame:
    """sig, id, m (the set's size): every set's signatures; copies within a task emit once. Sets that are short also have
    SHORT."""

    def make(sets, columns, seen):
        out = []
        for s in sets:
            key = (len(s), int(s.sum()), int(_mix(s).sum())) if len(s) else None
            if key is None or key in seen:
                out.append(np.empty(0, np.uint64))
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen[key] = True
            sigs, short = signatures(s, seed)
            out.append(np.append(sigs, np.array([SHORT], np.int64).view(np.uint64)) if short else sigs)
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in sets], pa.int64()), _lists(out)], ["id", "m", "sigs"])

    rows = _per_text(docs.where(F.col("id").isNotNull()).select("id", "text"), make, "id long, m long, sigs array<long>")
    return rows.select(F.explode("sigs").alias("sig"), "id", "m")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids' columns and ``shingles`` of the documents that ids (id and more) names."""
    few = ids.count() <= BROADCAST_ROWS
    chosen = docs.join(F.broadcast(ids) if few else ids, "id").select(*ids.columns, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids.schema.fields) + ", shingles array<bigint>"
    names = [*ids.columns, "shingles"]
    return _per_text(chosen, lambda sets, columns, _: pa.RecordBatch.from_arrays([*columns, _lists(sets)], names), schema)


def _small(df: DataFrame) -> DataFrame:
    """df, written once, and to be broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sets are alike enough, compared whole."""
    pairs = cut(pairs)
    sets = lambda end, name: sets_of(docs, pairs.select(F.col(end).alias("id")).distinct()).select(F.col("id").alias(end), F.col("shingles").alias(name))
    both = F.size(F.array_intersect("a", "b"))
    alike = DEN * both >= NUM * (F.size("a") + F.size("b") - both)
    return cut(pairs.join(sets("v", "a"), "v").join(sets("u", "b"), "u").where(alike).select("u", "v").distinct())


def _sharing_rare(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs across roots of rows (id, root) that share one of the rarest shingles of each."""
    elements = cut(sets_of(docs, rows.distinct()).select("id", "root", F.size("shingles").alias("m"), F.explode("shingles").alias("shingle")))
    often = elements.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle"))
    rarest = elements.join(often, "shingle").withColumn("i", place).where((F.col("i") <= F.col("m") - _overlap(F.col("m"), F.ceil(F.col("m") * NUM / DEN)) + 1) & (F.col("lo") != F.col("hi")))
    a = rarest.select("shingle", F.col("id").alias("u"), F.col("root").alias("ru"), F.col("m").alias("mu"), F.col("i").alias("iu"))
    b = rarest.select("shingle", F.col("id").alias("v"), F.col("root").alias("rv"), F.col("m").alias("mv"), F.col("i").alias("iv"))
    # The first shingle that a linked pair shares in the common order leaves room for the rest of their overlap in both.
    shared = _overlap(F.col("mu"), F.col("mv"))
    room = (F.col("mu") - F.col("iu") + 1 >= shared) & (F.col("mv") - F.col("iv") + 1 >= shared)
    near = (DEN * F.col("mu") >= NUM * F.col("mv")) & (DEN * F.col("mv") >= NUM * F.col("mu"))
    return a.join(b, "shingle").where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & near & room).select("u", "v").distinct()


def _overlap(a: Column, b: Column) -> Column:
    """Least intersection of linked sets of sizes a and b."""
    return F.ceil((a + b) * NUM / (NUM + DEN))


def _rooted(df: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """df with the root (v of roots, where its u is the column's id) of a column, or the id itself."""
    found = roots.select(F.col("u").alias(column), F.col("v").alias(name))
    return df.join(F.broadcast(found) if roots.count() <= BROADCAST_ROWS else found, column, "left").withColumn(name, F.coalesce(name, column))


def _sized(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs u, v whose sizes allow a link, with the sizes: au to bu and av to bv, which differ only for
    repeated ids."""
    size = found.groupBy("id").agg(F.min("n_shingles").alias("a"), F.max("n_shingles").alias("b"))
    few = size.count() <= BROADCAST_ROWS
    both = pairs
    for end in ("u", "v"):
        of = size.select(F.col("id").alias(end), F.col("a").alias(f"a{end}"), F.col("b").alias(f"b{end}"))
        both = both.join(F.broadcast(of) if few else of, end)
    return both.where((DEN * F.col("bu") >= NUM * F.col("av")) & (DEN * F.col("bv") >= NUM * F.col("au")))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs u, v that lie in different components."""
    both = _rooted(_rooted(pairs, "u", roots, "ru"), "v", roots, "rv")
    return both.where("ru <> rv").select(*pairs.columns)


def proposals(shared: DataFrame, found: DataFrame, certain: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs u, v (with n, the signatures they share) of the small signatures, and of every large one with its smallest
    document.

    With no set short, a linked pair shares at least k + 1 - (a + b) / 9 signatures, k being the smaller set's; those with fewer
    in small signatures can only be linked if they meet in a large one, which the other pairs see to.
    """
    partner = F.explode("next").alias("p")
    pairs = shared.where(F.col("n") <= FEW).select(F.col("id").alias("u"), F.col("m").alias("a"), partner).where(F.col("u") != F.col("p.id"))
    pairs = pairs.groupBy("u", "a", F.col("p.id").alias("v"), F.col("p.m").alias("b")).agg(F.count("*").alias("n"))
    least = F.least("a", "b")
    need = F.floor((least + F.floor(least * DEN / NUM)) / 9) + 1 - F.floor((F.col("a") + F.col("b")) / 9) if certain else F.lit(1)
    near = (DEN * F.col("a") >= NUM * F.col("b")) & (DEN * F.col("b") >= NUM * F.col("a"))
    pairs = pairs.where(near & (F.col("n") >= need)).groupBy("u", "v").agg(F.max("n").alias("n"))
    stars = shared.where((F.col("n") > FEW) & (F.col("id") != F.col("lo"))).groupBy(F.col("lo").alias("u"), F.col("id").alias("v")).agg(F.count("*").alias("n"))
    return pairs, _sized(stars, found).select("u", "v", "n")


def crowded(docs: DataFrame, seed: int) -> DataFrame:
    """sig, hot (true): the signatures that many of the documents looked at have, about LOOKED_AT * HOT rows of all and more,
    and no more of them than are broadcast."""
    seen = signed(docs.where(F.pmod(F.xxhash64("id"), F.lit(LOOKED_AT)) == 0), seed).groupBy("sig").agg(F.count("*").alias("n"))
    seen, least = cut(seen.where((F.col("n") >= HOT) & (F.col("sig") != SHORT))), HOT
    while seen.where(F.col("n") >= least).count() > BROADCAST_ROWS:
        least *= 2
    return F.broadcast(seen.where(F.col("n") >= least).select("sig", F.lit(True).alias("hot")))


def grouped(docs: DataFrame, seed: int) -> DataFrame:
    """signed() rows of signatures of several sets, and of SHORT, with the signature's smallest id (lo), its rows (n) and, up to
    FEW rows, those that follow (next). No signature's rows all meet in one task, but for those that are not crowded."""
    salt = F.when((F.col("sig") == SHORT) | F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0))
    rows = signed(docs, seed).join(crowded(docs, seed), "sig", "left").withColumn("salt", salt)
    bucket = Window.partitionBy("sig", "salt").orderBy("id")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("lo", F.min("id").over(whole)).withColumn("n", F.count("*").over(whole))
    small = F.col("hot").isNull() & (F.col("sig") != SHORT) & (F.col("n") <= FEW)
    rows = rows.where((F.col("n") > 1) | F.col("hot").isNotNull() | (F.col("sig") == SHORT))
    rows = stored(rows.withColumn("next", F.when(small, F.collect_list(F.struct("id", "m")).over(bucket.rowsBetween(1, FEW - 1)))).drop("salt"))
    # A crowded signature is a large one, however its rows are dealt.
    total = rows.where("hot").groupBy("sig").agg(F.min("lo").alias("_lo"), F.greatest(F.count("*"), F.lit(FEW + 1)).alias("_n"))
    rows = rows.join(F.broadcast(cut(total)), "sig", "left")
    return rows.select("sig", "id", "m", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_n", "n").alias("n"), "next")


def links(docs: DataFrame, found: DataFrame, copies: DataFrame) -> DataFrame:
    """The components of docs (id, text), whose set sizes found has, as u with the smallest v: from copies (u of equal set
    as the smallest v), and such links, each exact, that no other link changes a component."""
    roots, short, seed = copies, None, 0
    while True:
        shared = grouped(docs, seed)
        here = shared.where(F.col("sig") == SHORT).select("id")
        certain = not here.take(1)
        groups = shared.where(F.col("sig") != SHORT)
        pairs, stars = proposals(groups, found, certain)
        pairs = pairs.unionByName(stars)
        # Of equal sets one is compared. A set is compared with its likeliest partner first, then with others outside its component.
        pairs = _rooted(_rooted(pairs, "u", copies, "a"), "v", copies, "b").where("a <> b")
        pairs = pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("n").alias("n"))
        pairs = cut(_apart(pairs, roots) if seed else pairs)
        roots = extended(roots, linked(docs, pairs.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u"))))
        roots = extended(roots, linked(docs, _apart(pairs, roots).select("u", "v")))
        # What is left: large signatures of several components.
        rows = _rooted(groups.where(F.col("n") > FEW).select("sig", "id"), "id", roots, "root")
        mixed = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        rows = rows.join(_small(mixed.where("lo <> hi").select("sig")), "sig").select("id", "root")
        roots = extended(roots, linked(docs, _sharing_rare(docs, rows)))
        short = here if short is None else short.join(here, "id", "left_semi")
        if certain or not short.take(1):
            return roots
        seed += 1


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id, the smallest key that links reach, for every row of df."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = cut(sizes(docs))
    named = found.where("id IS NOT NULL AND n_shingles > 0")
    copies = named.groupBy("n_shingles", "k1", "k2").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    # One row for each set that repeats; few enough to be broadcast, so that a large group of copies is not dealt to one task.
    copies = cut(named.join(_small(copies), ["n_shingles", "k1", "k2"]).where("id <> v").groupBy(F.col("id").alias("u")).agg(F.min("v").alias("v")))
    roots = links(docs, named, copies)
    out = found.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("root", "id").alias("component_id"))
