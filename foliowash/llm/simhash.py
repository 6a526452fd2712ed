"""SimHash near-duplicates: fingerprints of word shingles, and a binary-trie self-join on them.

A fingerprint bit is 1 if it is set in over half the XXH64 values (seed 42) of a text's shingles.
Pairs within ``errors`` bits are found without comparing all pairs: the 64 bits are cut into blocks so
that any such pair agrees in some set of blocks; each set rotates its bits to the front and keys one
exchange; within a key a binary trie over the remaining bits is joined with itself, node pairs level by
level, dropping a pair as soon as its differing bits exceed the budget. Only distinct fingerprints take
part, so a group of exact copies is one leaf, and a fingerprint has at most as many partners as the
Hamming ball holds. Each task emits a spanning forest of the links it finds: components are all that is
asked for, and a link whose ends are joined already adds nothing.

Edge cases: null or empty texts have the fingerprint zero and link like any other; texts of fewer words
than a shingle have one shingle of all words; repeated rows share fingerprint and component; rows with a
null doc_id get the component of their fingerprint's other rows, or null; an empty table stays empty.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowash.llm import minhash
from foliowash.llm.bytewords import slices, spaced, words
from foliowash.llm.common import components, quoted, tidy, write_stage

SHINGLE, ERRORS = 3, 2


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints, one per text."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, j in slices(texts, 4 << 20):
        w = words(texts[i:j])
        data, start, end = spaced(w)
        n_words = w.counts
        n = np.where(n_words == 0, 0, np.maximum(1, n_words - shingle + 1))
        doc = np.repeat(np.arange(j - i), n)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at = w.first[:-1][doc] + inner
        till = np.minimum(at + shingle, w.first[1:][doc]) - 1
        view, digest = memoryview(data), xxhash.xxh64_intdigest
        counts = np.zeros((j - i, 64), dtype=np.int64)
        for a in range(0, len(doc), 1 << 17):
            b = min(len(doc), a + (1 << 17))
            h = np.array([digest(view[s:e], 42) for s, e in zip(start[at[a:b]].tolist(), end[till[a:b]].tolist(), strict=True)], dtype="<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = doc[a:b]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            counts[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        over = (counts * 2 > n[:, None]).astype(np.uint8)
        out[i:j] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id (or other keys, as longs) and fp (the fingerprint's bits as a signed long)."""
    names = [*keys, "fp"]

    def run(batches):
        for batch in batches:
            fp = fingerprints_of(batch.column(len(keys)), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=names)

    return docs.select(*[F.col(k).cast("long").alias(k) for k in keys], "text").mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def trie_join(values: np.ndarray, errors: int, skip: int = 0, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of sorted distinct uint64 values that differ in at most ``errors`` bits, and in
    their labels, if there are any.

    The first ``skip`` bits are equal in all values. Nodes are ranges of the sorted values.
    """
    n = len(values)
    # how often the label has changed up to each value: a range of one label has the same number at both ends
    changes = None if labels is None else np.cumsum(np.concatenate([[0], labels[1:] != labels[:-1]])[:n])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    a_lo, a_hi, b_lo, b_hi = (np.array([x], dtype=np.int64) for x in (0, n, 0, n))
    cost = np.zeros(1, dtype=np.int64)

    def settle(lo, hi, lo2, hi2, same):
        """Compares the values of small node pairs directly."""
        size, size2 = hi - lo, hi2 - lo2
        total = size * size2
        for s in range(0, len(lo), 1 << 16):
            t = total[s : s + (1 << 16)]
            pair = np.repeat(np.arange(s, s + len(t)), t)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(t) - t, t)
            i, j = lo[pair] + inner // size2[pair], lo2[pair] + inner % size2[pair]
            keep = ~same[pair] | (i < j)
            i, j = i[keep], j[keep]
            near = np.bitwise_count(values[i] ^ values[j]) <= errors
            if labels is not None:
                near &= labels[i] != labels[j]
            found.append((i[near], j[near]))

    for bit in range(skip, 64):
        if not len(cost):
            break
        small = (a_hi - a_lo) * (b_hi - b_lo) <= 64
        if small.any():
            settle(a_lo[small], a_hi[small], b_lo[small], b_hi[small], a_lo[small] == b_lo[small])
            a_lo, a_hi, b_lo, b_hi, cost = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, cost))
            if not len(cost):
                break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1))]).astype(np.int64)
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo
        parts = [
            (a_lo, a_mid, b_lo, b_mid, cost, np.ones(len(cost), bool)),
            (a_mid, a_hi, b_mid, b_hi, cost, np.ones(len(cost), bool)),
            (a_lo, a_mid, b_mid, b_hi, cost + 1, cost < errors),
            (a_mid, a_hi, b_lo, b_mid, cost + 1, (cost < errors) & ~same),
        ]
        rows = []
        for lo, hi, lo2, hi2, c, ok in parts:
            ok = ok & (lo < hi) & (lo2 < hi2)
            ok &= ~((lo == lo2) & (hi - lo == 1) & (hi2 - lo2 == 1))
            if changes is not None:
                lo, hi, lo2, hi2, c = (x[ok] for x in (lo, hi, lo2, hi2, c))
                ok = (labels[lo] != labels[lo2]) | (changes[lo] != changes[hi - 1]) | (changes[lo2] != changes[hi2 - 1])
            rows.append(tuple(x[ok] for x in (lo, hi, lo2, hi2, c)))
        a_lo, a_hi, b_lo, b_hi, cost = (np.concatenate(x) for x in zip(*rows, strict=True))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by vectorised label passing with pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _plans(errors: int) -> list[tuple[int, ...]]:
    """Orders of the 64 bits: for 2 errors three blocks, one in front; for more, sets of two blocks."""
    if errors <= 2:
        n, front = errors + 1, 1
    else:
        n, front = errors + 2, 2
    bounds = [round(64 * k / n) for k in range(n + 1)]
    plans = []
    for chosen in combinations(range(n), front):
        lead = [b for k in chosen for b in range(bounds[k], bounds[k + 1])]
        plans.append((len(lead), *lead, *[b for b in range(64) if b not in set(lead)]))
    return plans


def _permute(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits[:, list(order)]), axis=1).view(">u8").ravel().astype(np.uint64)


def links(classes: DataFrame, errors: int = ERRORS) -> DataFrame:
    """From (fp, rep), fp distinct: edges (a, b) between reps that connect all fps within ``errors`` bits."""
    return _joined(classes, errors)


def _joined(classes: DataFrame, errors: int) -> DataFrame:
    """``links``; if ``classes`` has a label, all pairs (a, b) of reps of fps within ``errors`` bits whose labels
    differ, some of them more than once."""
    plans = _plans(errors)
    names = [c for c in classes.columns if c != "fp"]

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, (lead, *order) in enumerate(plans):
                turned = _permute(fp, tuple(order)) if len(fp) else fp
                head = (turned >> np.uint64(64 - lead)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(head), pa.array(turned.view(np.int64)), *batch.columns[1:]], names=["plan", "head", "turned", *names])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turned", key=lambda s: s.astype(np.int64).to_numpy().view(np.uint64))
        values, reps = pdf["turned"].to_numpy(np.int64).view(np.uint64), pdf["rep"].to_numpy(np.int64)
        group = pdf["plan"].to_numpy(np.int64)
        labels = pdf["label"].to_numpy(np.int64) if "label" in names else None
        out = []
        for k in np.unique(group):
            mine = np.flatnonzero(group == k)
            i, j = trie_join(values[mine], errors, labels=None if labels is None else labels[mine])
            if labels is not None:
                out.append(pd.DataFrame({"a": reps[mine[i]], "b": reps[mine[j]]}))
            elif len(i):
                r = reps[mine]
                by = np.argsort(r, kind="stable")
                back = np.empty(len(by), np.int64)
                back[by] = np.arange(len(by))
                label = forest(len(by), back[i], back[j])
                far = np.flatnonzero(label != np.arange(len(by)))
                out.append(pd.DataFrame({"a": r[by][far], "b": r[by][label[far]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    dealt = classes.select("fp", *names).mapInArrow(tidy(deal), "plan int, head long, turned long, " + ", ".join(f"{c} long" for c in names))
    # heads that share a bucket are joined in one trie: values of different heads may then link too, which
    # is right as every pair is compared on all its bits
    buckets = max(16, min(100_000, classes.count() * len(plans) // 20_000))
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("plan", "head"), F.lit(buckets))).groupBy("bucket").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every row."""
    marked = write_stage(fingerprints(docs, shingle), "fingerprints")
    classes = write_stage(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    joined = components(links(classes, errors))
    of = classes.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def class_fingerprints(members: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, fp), written, of classes with a row (id, doc_id, row) for each member: texts of one set of shingles
    have different fingerprints if they repeat some."""
    of = members.select("id", "doc_id", "row").join(fingerprints(docs, shingle, ("doc_id", "row")), ["doc_id", "row"])
    return write_stage(of.select("id", "fp").distinct(), "class_fingerprints")


def first_pairs(of: DataFrame, errors: int = ERRORS) -> DataFrame:
    """Pairs (a, b) of ids that connect all classes (id, fp) whose fingerprints are linked: each with the first of
    its fingerprint, and the trie join's links between those. Far fewer than all such pairs."""
    firsts = write_stage(of.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprints")
    same = of.join(firsts, "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return same.unionByName(links(firsts, errors))


def fingerprint_pairs(members: DataFrame, docs: DataFrame, shingle: int, errors: int = ERRORS) -> DataFrame:
    """``first_pairs`` of classes' members (id, doc_id, row)."""
    return first_pairs(class_fingerprints(members, docs, shingle), errors)


def apart_pairs(of: DataFrame, parts: DataFrame, errors: int = ERRORS) -> DataFrame:
    """All pairs of classes (id, fp) whose fingerprints are linked and which stand in different parts, of
    (id, n, part): (id, n, other, m). A pair that ``first_pairs`` only connects through a third class, with
    which neither need be similar, is among them unless similar classes connect it."""
    nodes = write_stage(of.join(parts, "id"), "nodes")
    fps = nodes.groupBy("fp").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    # a fingerprint of several parts has a label of its own: ids of classes are not negative
    label = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.monotonically_increasing_id())
    fps = write_stage(fps.select("fp", F.col("fp").alias("rep"), label.alias("label")), "labels")
    pairs = _joined(fps, errors).unionByName(fps.where("label < 0").select(F.col("fp").alias("a"), F.col("fp").alias("b"))).distinct()
    side = lambda fp, *names: nodes.select(F.col("fp").alias(fp), *[F.col(c).alias(x) for c, x in zip(("id", "n", "part"), names, strict=True)])
    met = pairs.join(side("a", "id", "n", "part"), "a").join(side("b", "other", "m", "apart"), "b")
    return met.where("part <> apart AND (a <> b OR id < other)").select("id", "n", "other", "m")


def keep_one(docs: DataFrame, shingle: int = minhash.SHINGLE, errors: int = ERRORS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates (similarity of shingle sets 0.8 or more). SimHash
    fingerprints within ``errors`` bits are paired by the trie join, and the pairs are compared on their whole
    sets: first those that connect each group of fingerprints, then all whose classes are not connected by
    similar ones. MinHash bands (``minhash``) add the pairs that differ in more bits. Of each component
    the first row stays, by doc_id and then by a hash of the text, which tells texts of one doc_id apart;
    once if it is repeated. Rows with a null doc_id take no part and stay. All columns are kept, whatever
    their names; of rows equal in doc_id and text that differ elsewhere, any one stays."""

    def candidates(members: DataFrame, rows: DataFrame):
        of = class_fingerprints(members, rows, shingle)
        return first_pairs(of, errors), lambda parts: apart_pairs(of, parts, errors)

    kept = minhash.first_of_each(docs, shingle, candidates).withColumnRenamed("doc_id", "kept_id")
    known = F.col("doc_id").isNotNull()
    rows = docs.where(known).select(F.struct(*quoted(docs)).alias("input"), F.col("doc_id").cast("long").alias("kept_id"), F.xxhash64("text").alias("row"))
    # the kept rows are numbers only: the texts need not be sorted to meet them
    rows = rows.join(kept.hint("shuffle_hash"), ["kept_id", "row"])
    again = rows.where("times > 1").groupBy("kept_id", "row").agg(F.first("input").alias("input"))
    out = rows.where("times = 1").select("input").unionByName(again.select("input"))
    return out.select(*[F.col("input").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where(~known))
