"""Token ids in grammar-compressed binary blocks (Re-Pair), with random access to each document.

``write`` ranges documents over shards by doc_id, encodes them and stores blocks of about ``block_ids``
ids. In each block, frequent adjacent pairs of symbols are replaced by new symbols, in at most ``rounds``
rounds (3, as more cost CPU time that the rest of the job has no room for; a symbol then stands for 8 ids
at most) or until no pair is found ``least`` times: a round counts all pairs, takes the ``per_round`` most
frequent ones as rules and replaces them left to right. A pair
never crosses a document's end. Blocks are binary values of a Parquet table in the shared folder, so
writing is atomic per task and repeats after a lost executor.

Block format, little-endian: magic ``FWRP``, uint32 version, uint64 n_docs, n_ids, n_symbols, n_rules,
first rule's number; int64 doc_ids (nulls: bit in a mask of bytes), uint32 ids per document, uint32 pairs
of the rules, uint32 expansion lengths of the rules, uint32 symbol number at which each document begins,
then the symbols (uint16 if all fit, else uint32; the version's bit 8 tells).

Edge cases: null texts are empty documents of one id; repeated doc_ids stay separate rows, in any order
among themselves; null doc_ids come first; an empty table gives no block; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliowash.llm.common import partitions_for, tidy, write_stage
from foliowash.llm.tokens import default_vocabulary, encoder

_HEAD = struct.Struct("<4sI5Q")
_HASH_BITS = 20
CACHE = 64 << 20  # bytes of encoded chunks that a worker keeps: this job has the memory, and little CPU time to spare


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


def compress(ids: np.ndarray, bounds: np.ndarray, rounds: int = 3, per_round: int = 4096, least: int = 8, first: int | None = None):
    """(symbols, bounds of documents in symbols, rules (n, 2), expansion lengths, number of the first rule)."""
    first = int(first if first is not None else (int(ids.max()) + 1 if len(ids) else 0))
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    last[ends] = True
    rules, size = np.empty((0, 2), np.uint32), np.empty(0, np.uint32)
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        keys = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        inner = np.flatnonzero(~last[:-1])
        ranked = np.sort(keys[inner])
        cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
        count = np.diff(np.append(cut, len(ranked)))
        common = count >= least
        pairs, count = ranked[cut[common]], count[common]
        order = np.lexsort((pairs, -count))[:per_round]
        pairs = pairs[order]
        _, kept = np.unique(_slot(pairs), return_index=True)  # one pair a slot, the most frequent
        pairs = pairs[np.sort(kept)]
        if not len(pairs):
            break
        table = np.full(1 << _HASH_BITS, -1, dtype=np.int32)
        table[_slot(pairs)] = np.arange(len(pairs))
        rule = table[_slot(keys)]
        at = np.flatnonzero((rule >= 0) & ~last[:-1])
        at = at[pairs[rule[at]] == keys[at]]
        # left to right: of overlapping occurrences every other one is replaced
        starts = np.concatenate([[True], np.diff(at) > 1])
        run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        base = first + len(rules)
        new = np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)], axis=1)
        both = np.append(np.uint32(1), size)[np.maximum(new.astype(np.int64) - first + 1, 0)]  # 1 for an id
        rules = np.concatenate([rules, new])
        size = np.concatenate([size, both.sum(axis=1).astype(np.uint32)])
        symbols[at] = base + rule[at]
        last[at] |= last[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
    symbol_bounds = np.zeros(len(bounds), dtype=np.int64)
    full = np.diff(bounds) > 0
    symbol_bounds[1:][full] = np.flatnonzero(last) + 1
    return symbols, np.maximum.accumulate(symbol_bounds), rules, size, first


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of symbols; rules only use earlier ones, so each pass opens all that are left."""
    while len(rules) and len(symbols) and (open_ := symbols >= first).any():
        n = 1 + open_.astype(np.int64)
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.uint32)
        out[at] = symbols
        inside = rules[symbols[open_].astype(np.int64) - first]
        out[at[open_]], out[at[open_] + 1] = inside[:, 0], inside[:, 1]
        symbols = out
    return symbols.astype(np.uint32)


def to_bytes(doc_ids: np.ndarray, nulls: np.ndarray, bounds: np.ndarray, packed) -> bytes:
    symbols, symbol_bounds, rules, size, first = packed
    short = first + len(rules) <= 1 << 16
    parts = [
        _HEAD.pack(b"FWRP", 1 | (not short) << 8, len(doc_ids), int(bounds[-1]), len(symbols), len(rules), first),
        doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), np.diff(bounds).astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
        size.astype("<u4").tobytes(), symbol_bounds[:-1].astype("<u4").tobytes(), symbols.astype("<u2" if short else "<u4").tobytes(),
    ]
    return b"".join(parts)


class Block:
    """Reads one block; ``document(k)`` expands only the k-th document's symbols."""

    def __init__(self, data: bytes):
        magic, version, n_docs, self.n_ids, n_symbols, n_rules, self.first = _HEAD.unpack_from(data)
        if magic != b"FWRP" or version & 0xFF != 1:
            raise ValueError("not a block of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.sizes = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u4", n_docs)
        self.rules, self.rule_sizes = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.starts, self.symbols = take("<u4", n_docs), take("<u4" if version >> 8 else "<u2", n_symbols)

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        return expand(self.symbols[self.starts[k] : end].astype(np.uint32), self.rules, self.first)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        out = expand(self.symbols.astype(np.uint32), self.rules, self.first)
        return out, np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))])


BLOCKS = "shard int, block int, n_docs long, n_ids long, first_id long, last_id long, data binary"


def write(docs: DataFrame, vocabulary: str | None = None, block_ids: int = 2_000_000, shards: int | None = None, **grammar) -> DataFrame:
    """Writes the blocks of ``docs`` and returns their table, in (shard, block) order of doc_id."""
    path = vocabulary or default_vocabulary()
    size = encoder(path).library.get_vocab_size()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = shards or partitions_for(docs, 16 << 20)

    def blocks(batches):
        shard, number, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, n_held
            ids = np.concatenate([x[2] for x in held])
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[3]) for x in held]))])
            data = to_bytes(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), bounds, compress(ids, bounds, first=size, **grammar))
            ids_here = np.concatenate([x[0] for x in held])[~np.concatenate([x[1] for x in held])]
            ends = [int(ids_here[0]), int(ids_here[-1])] if len(ids_here) else [None, None]
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "n_docs": [len(bounds) - 1], "n_ids": [len(ids)], "first_id": pa.array(ends[:1], pa.int64()), "last_id": pa.array(ends[1:], pa.int64()), "data": pa.array([data], pa.binary())})
            number, held, n_held = number + 1, [], 0
            return row

        for batch in batches:
            keys = batch.column(0)
            nulls, values = np.asarray(keys.is_null()), keys.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j, ids, bounds in encoder(path, CACHE).runs(batch.column(1), 8 << 20):
                k = 0
                while k < j - i:
                    m = max(k + 1, int(np.searchsorted(bounds, bounds[k] + block_ids - n_held, "right")) - 1)
                    held.append((values[i + k : i + m], nulls[i + k : i + m], ids[bounds[k] : bounds[m]], bounds[k : m + 1]))
                    n_held += int(bounds[m] - bounds[k])
                    if m < j - i or n_held >= block_ids:
                        yield flush()
                    k = m
        if held:
            yield flush()

    # the number splits rows of one doc_id, or of none
    numbered = source.withColumn("number", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(n, "doc_id", "number").sortWithinPartitions("doc_id", "number").drop("number")
    return write_stage(ranged.mapInArrow(tidy(blocks), BLOCKS), "token_blocks")


def document(table: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of a document's rows: only blocks whose range of doc_ids holds it are read, and only its own
    symbols are expanded."""
    found = []
    for row in table.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard", "block").select("data").toLocalIterator():
        b = Block(bytes(row["data"]))
        found += [b.document(int(k)) for k in np.flatnonzero((b.doc_ids == doc_id) & ~b.nulls)]
    return found


def read(table: DataFrame) -> DataFrame:
    """Decodes every document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches):
        for batch in batches:
            for shard, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = Block(data.as_buffer().to_pybytes())
                ids, bounds = b.ids()
                view = memoryview(np.ascontiguousarray(ids)).cast("B")
                at = (bounds * 4).tolist()
                sums = [zlib.crc32(view[x:y]) for x, y in zip(at, at[1:], strict=False)]
                n = len(b.sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(b.doc_ids, mask=b.nulls), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                    names=["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = table.select("shard", "block", "data").mapInArrow(tidy(decode), "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    sizes = table.select("shard", "block", "n_ids")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    inner = sizes.select("shard", "block", F.col("n_ids").alias("n")).withColumn("block_start", before(Window.partitionBy("shard").orderBy("block"))).drop("n")
    return rows.join(inner.join(shards, "shard"), ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
