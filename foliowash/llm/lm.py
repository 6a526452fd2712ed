"""Language-model scoring with a sharded Elias-Fano bigram trie.

Texts are read in blocks of bounded size. Each block sends, per shard of context words, its distinct
contexts with their training counts and its distinct (context, next word) pairs with theirs: the only
exchange that grows with the corpus. A shard adds the counts of all blocks and builds a trie of contexts
and the next words seen at least ``least`` times: monotone Elias-Fano levels for the contexts, the
pointers to their successors, and the successors relative to their context, beside probabilities
quantised to 8 bits. The levels are written to a file and mapped into memory; for each block's pairs, the
context is looked up, its pointers give the range of its successors, and the next word's successor is
searched there. The answers go back to the blocks, which score their texts. So no task ever holds the whole
model, counts cover every training text, and nothing but two totals reaches the driver.

P(w | v) = q(v w) + g(v) (c(w) + 1) / (N + V + 1), where q is the quantised (c(v w) - D) / c(v), rounded
down, of pairs in the trie, and g(v) is what the q of v leave of 1; so each context's distribution sums to
1 over the known words and one unknown word. A text starts after a start mark and ends with an end token.

Edge cases: null and empty texts are one token, the end; without training texts all counts are 0 and both
scores are equal; repeated rows count and score each; null doc_ids have a null fold and do not train; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowash.llm.bytewords import arrow_bytes, slices, words_of
from foliowash.llm.common import drop_stage, fold, partitions_for, tidy, trim, write_stage
from foliowash.llm.eliasfano import EliasFano

BLOCK_BYTES, LEAST, DISCOUNT = 5 << 20, 2, 0.75
_START, _END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0xC6A4A7935BD1E995)
_BITS = 40
_STEPS, _PER_STEP = 254, 8 / 254  # 8-bit codes: log10 from 0 to -8; 255: not in the trie
_NONE = 255


def _squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _open(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8)
    at, out = 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def blocks(docs: DataFrame, train: str = "train") -> DataFrame:
    """Rows (block, data): up to ``BLOCK_BYTES`` of text each, with the doc_ids and training flags."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in slices(batch.column(2), BLOCK_BYTES):
                data, offsets = arrow_bytes(batch.column(2)[i:j])
                keys = batch.column(0)[i:j]
                packed = _squeeze(keys.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(keys.is_null()).astype("u1"), batch.column(1)[i:j].fill_null(False).to_numpy(zero_copy_only=False).astype("u1"), offsets.astype("<i8"), data)
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "data": pa.array([packed], pa.binary())})
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), train, "text").mapInArrow(tidy(run), "block long, data binary")


class Block:
    """The distinct words and pairs of a block, with training counts, in an order that depends on them alone."""

    def __init__(self, data: bytes):
        self.doc_ids, nulls, train, offsets, text = _open(data, "<i8", "u1", "u1", "<i8", "u1")
        self.nulls, self.train = nulls.astype(bool), train.astype(bool)
        w = words_of(text, offsets)
        n = w.counts
        self.n_tokens = n + 1
        total = len(w.start) + 2 * len(n)  # a start mark, the words, an end
        seq = np.empty(total, dtype=np.uint64)
        first = np.concatenate([[0], np.cumsum(n + 2)])
        seq[first[:-1]] = _START
        seq[first[1:] - 1] = _END
        inner = np.ones(total, dtype=bool)
        inner[first[:-1]] = inner[first[1:] - 1] = False
        seq[inner] = w.hashes()
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
        self.words, at = np.unique(seq, return_inverse=True)
        del seq
        trains = self.train[doc]
        self.count = np.bincount(at[trains], minlength=len(self.words)).astype(np.uint32)
        token = np.ones(total, dtype=bool)
        token[first[:-1]] = False
        self.token_at, self.token_doc = np.flatnonzero(token), doc[token]
        self.word = at[self.token_at]
        pair = at[self.token_at - 1] * np.int64(len(self.words)) + self.word
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.pair_count = np.bincount(self.pair[trains[self.token_at]], minlength=len(self.pairs)).astype(np.uint32)
        self.before, self.next = self.pairs // len(self.words), self.pairs % len(self.words)

    def shards(self, n: int):
        """(shard, positions of its words, positions of the pairs that such words begin)."""
        of = ((self.words >> np.uint64(_BITS)) % np.uint64(n)).astype(np.int64)
        by, by_pair = np.argsort(of, kind="stable"), np.argsort(of[self.before], kind="stable")
        cut = np.searchsorted(of[by], np.arange(n + 1))
        cut_pair = np.searchsorted(of[self.before][by_pair], np.arange(n + 1))
        for s in range(n):
            if cut[s] < cut[s + 1]:
                yield s, by[cut[s] : cut[s + 1]], by_pair[cut_pair[s] : cut_pair[s + 1]]


def _five(x: np.ndarray) -> np.ndarray:
    """The low 40 bits as bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def requests(table: DataFrame, n_shards: int) -> DataFrame:
    """(shard, block, data): a block's words, their counts, pairs a word, next words, pair counts."""

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(data.as_buffer().to_pybytes())
                of, load = [], []
                for s, w, p in b.shards(n_shards):
                    n_pairs = np.bincount(np.searchsorted(w, b.before[p]), minlength=len(w))
                    of.append(s)
                    load.append(_squeeze(b.words[w].astype("<u8"), b.count[w].astype("<u4"), n_pairs.astype("<u4"), _five(b.words[b.next[p]]), b.pair_count[p].astype("<u4")))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([number] * len(of), pa.int64()), pa.array(load, pa.binary())], names=["shard", "block", "data"])

    return table.select("block", "data").mapInArrow(tidy(run), "shard int, block long, data binary")


class Trie:
    """One shard's contexts with their training counts and leftover mass, pointers to their successors, and
    the successors with their codes, in a file that is mapped into memory."""

    KINDS = ("<u8", "<f4", "u1")  # counts, log10 of the leftover mass, codes

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, counts: np.ndarray, level: np.ndarray, codes: np.ndarray):
        self.contexts, self.pointers, self.successors = contexts, pointers, successors
        self.counts, self.level, self.codes = counts, level, codes

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, keys: np.ndarray, pair_counts: np.ndarray, least: int = LEAST) -> Trie:
        """From sorted words with counts, and sorted keys (word's rank << 40 | next word) with theirs."""
        kept = pair_counts >= least
        keys, n = keys[kept], pair_counts[kept].astype(float)
        before = (keys >> np.uint64(_BITS)).astype(np.int64)
        code = np.ceil(-np.log10((n - DISCOUNT) / counts[before]) / _PER_STEP - 1e-9).clip(0, _STEPS).astype(np.uint8)
        free = 1 - np.bincount(before, 10.0 ** (-_PER_STEP * code), len(words))
        pointers = np.searchsorted(before, np.arange(len(words) + 1))
        levels = (EliasFano.encode(words, 1 << 64), EliasFano.encode(pointers, len(keys) + 1), EliasFano.encode(keys, max(1, len(words)) << _BITS))
        return cls(*levels, counts.astype("<u8"), np.log10(np.maximum(free, 1e-6)).astype("<f4"), code)

    def save(self, path: str) -> None:
        arrays = [*self.contexts.parts(), *self.pointers.parts(), *self.successors.parts(), self.counts, self.level, self.codes]
        with open(path, "wb") as out:
            out.write(np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes())
            for a in arrays:
                out.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> Trie:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view("<i8")[0])
        sizes, at, parts = raw[8 : 8 * (n + 1)].view("<i8").tolist(), 8 * (n + 1), []
        for k, size in enumerate(sizes):
            kind = cls.KINDS[k - 12] if k >= 12 else "<i8" if k % 4 in (0, 3) else "<u8"
            parts.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        return cls(EliasFano.of(parts[0:4]), EliasFano.of(parts[4:8]), EliasFano.of(parts[8:12]), *parts[12:])

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Places of words among the contexts, which all of them are in."""
        return self.contexts.successor(words)[0]

    def find(self, rank: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Codes of next words after the contexts of these ranks, ``_NONE`` where the trie hasn't the pair: the
        successor of the next word among those that the context's pointers span."""
        first, last = (self.pointers.values(rank + k).astype(np.int64) for k in (0, 1))
        out = np.full(len(rank), _NONE, dtype=np.uint8)
        some = np.flatnonzero(first < last)
        if len(some):
            at, same = self.successors.successor((rank[some].astype(np.uint64) << np.uint64(_BITS)) | following[some], first[some], last[some])
            out[some[same]] = self.codes[at[same]]
        return out


_REQUEST = ("<u8", "<u4", "<u4", "u1", "<u4")


def _built(requests: list[bytes], least: int) -> Trie:
    """The trie of all blocks' counts."""
    opened = [_open(d, *_REQUEST) for d in requests]
    words, at = np.unique(np.concatenate([o[0] for o in opened]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([o[1] for o in opened]), len(words)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(o[0]) for o in opened])])
    keys, weights = [], []
    for k, o in enumerate(opened):
        seen = o[4] > 0
        keys.append(((np.repeat(at[bounds[k] : bounds[k + 1]], o[2]).astype(np.uint64) << np.uint64(_BITS)) | _from_five(o[3]))[seen])
        weights.append(o[4][seen])
    del opened, at
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    total = np.add.reduceat(weights.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    return Trie.build(words, counts, keys[first], total, least)


def answers(asked: DataFrame, least: int = LEAST) -> DataFrame:
    """(block, shard, data): counts, log10 g and codes in the request's order; block -1 has a shard's totals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        with tempfile.TemporaryDirectory() as folder:  # this task's own scratch file, gone at its end
            _built(pdf["data"].tolist(), least).save(os.path.join(folder, "trie"))
            trie = Trie.load(os.path.join(folder, "trie"))  # all that answers
            rows, mark = [], trie.rank(np.array([_START]))[0]
            for data in pdf["data"]:
                words, _, n_pairs, following, _ = _open(data, *_REQUEST)
                rank = trie.rank(words)
                rows.append(_squeeze(trie.counts[rank], trie.level[rank], trie.find(np.repeat(rank, n_pairs), _from_five(following))))
            counts = np.array(trie.counts)
            # the start mark is no token
            if mark < trie.contexts.n and trie.contexts.values(np.array([mark]))[0] == _START:
                counts[mark] = 0
            del trie
        trim()
        shard = int(pdf["shard"].iloc[0])
        none = [0] * len(rows)
        return pd.DataFrame({"block": [*pdf["block"].tolist(), -1], "shard": [shard] * (len(rows) + 1), "data": [*rows, b""], "n": [*none, int(counts.sum())], "v": [*none, int((counts > 0).sum())]})

    return asked.groupBy("shard").applyInPandas(run, "block long, shard int, data binary, n long, v long")


def score(table: DataFrame, answered: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row."""
    totals = answered.where("block < 0").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(totals[0] or 0), int(totals[1] or 0)

    def run(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b = Block(own["data"].iloc[0])
        by_shard = dict(zip(found["shard"].tolist(), found["data"], strict=True))
        count, level, code = np.zeros(len(b.words)), np.zeros(len(b.words)), np.full(len(b.pairs), _NONE, np.uint8)
        for s, w, p in b.shards(n_shards):
            count[w], level[w], code[p] = _open(by_shard[s], "<u8", "<f4", "u1")
        base = (count + 1) / (n + v + 1)
        q = np.where(code == _NONE, 0.0, 10.0 ** (-_PER_STEP * code))
        pair_score = np.log10(q + 10.0 ** level[b.before] * base[b.next])
        docs, size = b.token_doc, len(b.doc_ids)
        return pd.DataFrame({
            "doc_id": pd.array(b.doc_ids, "Int64").copy() if not b.nulls.any() else pd.array(np.where(b.nulls, None, b.doc_ids), "Int64"),
            "n_tokens": b.n_tokens, "n_known": np.bincount(docs, count[b.word] > 0, size).astype(np.int64), "train_tokens": n,
            "base_score": np.bincount(docs, np.log10(base)[b.word], size), "score": np.bincount(docs, pair_score[b.pair], size),
        })

    return table.groupBy("block").cogroup(answered.where("block >= 0").groupBy("block")).applyInPandas(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame, folds: int = 7, held: int = 2, least: int = LEAST) -> DataFrame:
    """Learns from documents outside the held-out fold and scores all."""
    n_shards = partitions_for(docs, 8 << 20)
    marked = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) != held).alias("train"))
    table = write_stage(blocks(marked), "blocks")
    answered = write_stage(answers(requests(table, n_shards), least), "answers")
    out = score(table, answered, n_shards)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
