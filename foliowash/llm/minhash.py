"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find pairs, exact sets decide.

A text's set is its distinct 64-bit shingle hashes. Texts of equal sets (128 bits of sums) are one class.
Each class has ``BANDS`` keys of ``ROWS`` minima; a pair of similarity s shares none with probability
(1 - s**ROWS)**BANDS, 5e-6 at 0.8 and less above. Within a key, classes are first compared in a chain by
size, so that a group of near copies costs as many comparisons as it has members; then all pairs of a key
that the links so far leave in different components are compared. Every comparison is on the whole sets.

Edge cases: null and empty texts have the empty set and are one class; texts of fewer words than a shingle
have one shingle of all words; different texts of one doc_id are nodes of their own, told apart by a hash
of the text; null doc_ids take no part. Pairs of a key that are alike but under the bound are all compared,
which grows with the square of such a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliowash.llm.bytewords import mix, slices, words
from foliowash.llm.common import components, drop_stage, tidy, write_stage

SHINGLE, BANDS, ROWS = 5, 40, 6
#: Least similarity as a fraction, so that the test is exact.
LEAST = (4, 5)

_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_FLIP = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, in this order."""
    w = words(texts)
    h, n_words = w.hashes(), w.counts
    n = np.where(n_words == 0, 0, np.maximum(1, n_words - shingle + 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = w.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    till = w.first[1:][doc]
    out = np.zeros(len(doc), dtype=np.uint64)
    for k in range(shingle):
        inside = at + k < till
        with np.errstate(over="ignore"):
            out[inside] = mix(out[inside] + np.uint64(k + 1) ^ h[at[inside] + k])
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return doc[new], out[new]


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row, k1 and k2 (the class), n (the set's size) and bands (its keys; none for the empty set)."""

    def of(texts: pa.Array):
        doc, h = shingle_sets(texts, shingle)
        n = np.bincount(doc, minlength=len(texts))
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]
        keys = np.zeros((2, len(texts)), dtype=np.uint64)
        bands = np.zeros((len(some), BANDS), dtype=np.uint64)
        if len(some):
            with np.errstate(over="ignore"):
                for k in range(2):
                    keys[k, some] = np.add.reduceat(mix(h ^ np.uint64(0x9E3779B97F4A7C15 * k)) if k else h, first)
                low, least = (h >> np.uint64(32)).astype(np.uint32), np.empty((BANDS * ROWS, len(some)), dtype=np.uint32)
                for k in range(BANDS * ROWS):
                    least[k] = np.minimum.reduceat((low ^ _FLIP[k]) * _TIMES[k], first)
                bands += np.arange(1, BANDS + 1, dtype=np.uint64)
                for row in least.reshape(BANDS, ROWS, -1).transpose(1, 2, 0):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + row)
        bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
        return keys[0].view(np.int64), keys[1].view(np.int64), n.astype(np.int64), pa.ListArray.from_arrays(pa.array(bounds), pa.array(bands.ravel().view(np.int64)))

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2), 1 << 19):
                k1, k2, n, bands = of(batch.column(2)[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(k1), pa.array(k2), pa.array(n), bands], names=["doc_id", "row", "k1", "k2", "n", "bands"])

    return docs.select("doc_id", "row", "text").mapInArrow(tidy(run), "doc_id long, row long, k1 long, k2 long, n long, bands array<long>")


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of classes whose sets have at least ``LEAST`` similarity."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    asked = classes.join(asked, "id").select("id", "doc_id", "row")
    # equal rows give one text
    texts = write_stage(docs.join(asked, ["doc_id", "row"]).select("id", "text").dropDuplicates(["id"]), "texts")
    side = lambda p: texts.select(F.col("id").alias(p), F.col("text").alias(f"text_{p}"))

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2), 4 << 20):
                sets = [shingle_sets(batch.column(k)[i:j], shingle) for k in (2, 3)]
                total = sum(np.bincount(d, minlength=j - i) for d, _ in sets)
                doc, h = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=j - i)
                near = pa.array(both * LEAST[1] >= (total - both) * LEAST[0])
                yield pa.RecordBatch.from_arrays([batch.column(k)[i:j].filter(near) for k in (0, 1)], names=["a", "b"])

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    found = write_stage(met.mapInArrow(tidy(run), "a long, b long").distinct(), "similar")
    drop_stage(texts)
    return found


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, candidates=None) -> DataFrame:
    """(doc_id, row, times): the first row of each group of near-duplicates, by doc_id and then by a hash of
    the text (``row``), and how many equal rows there are. ``candidates`` makes, from the classes' members
    (id, doc_id, row) and the rows, further pairs (a, b) of classes, which are compared with those of the chains, and a function from
    (id, n, part) to further pairs (id, n, other, m) of classes that those leave in different parts."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    marked = write_stage(signatures(docs, shingle), "signatures")
    classes = marked.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = write_stage(classes.select(F.monotonically_increasing_id().alias("id"), "rep.*", "k1", "k2", "n", "bands"), "classes")
    keyed = classes.select(F.explode("bands").alias("band"), "id", "n")
    common = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("band")
    shared = write_stage(keyed.join(common, "band"), "shared")
    close = lambda m, n: F.least(m, n) * LEAST[1] >= F.greatest(m, n) * LEAST[0]
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    by_size = Window.partitionBy("band").orderBy("n", "id")
    chain = shared.select("id", "n", F.lag("id").over(by_size).alias("other"), F.lag("n").over(by_size).alias("m"))
    tried = chain.where((F.col("id") != F.col("other")) & close("m", "n")).select(*pair("id", "other"))
    if candidates is not None:
        members = marked.select("doc_id", "row", "k1", "k2").join(classes.select("id", "k1", "k2"), ["k1", "k2"])
        more, apart = candidates(members, docs)
        tried = tried.unionByName(more.where("a <> b").select(*pair("a", "b")))
    tried = write_stage(tried.distinct(), "chain")
    links = similar(tried, classes, docs, shingle)
    joined = write_stage(components(links), "joined")

    placed = shared.join(joined, F.col("id") == F.col("node"), "left").select("band", "id", "n", F.coalesce("component", "id").alias("part"))
    mixed = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band")
    open_ = write_stage(placed.join(mixed, "band"), "open")
    other = open_.select("band", F.col("id").alias("other"), F.col("n").alias("m"), F.col("part").alias("apart"))
    rest = open_.join(other, "band").where((F.col("part") < F.col("apart")) & close("m", "n")).select(*pair("id", "other"))
    if candidates is not None:
        parts = classes.join(joined, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("component", "id").alias("part"))
        rest = rest.unionByName(apart(parts).where(close("m", "n")).select(*pair("id", "other")))
    rest = write_stage(rest.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    drop_stage(shared, open_, tried)
    if rest.limit(1).count():
        more = similar(rest, classes, docs, shingle)
        if more.limit(1).count():
            joined = write_stage(components(links.unionByName(more)), "joined")
    drop_stage(rest, links)
    of = classes.join(joined, F.col("id") == F.col("node"), "left")
    first = of.groupBy(F.coalesce("component", "id").alias("part")).agg(F.min(F.struct("doc_id", "row")).alias("rep")).select("rep.*")
    times = marked.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("times"))
    out = write_stage(first.join(times, ["doc_id", "row"]), "first")
    drop_stage(marked, classes, joined)
    return out
