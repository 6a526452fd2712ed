"""Best-fit packing of token sequences, improved by swap-based local search.

``pieces`` cuts documents into pieces of at most ``capacity`` tokens; ``pack`` places pieces in sequences.
Pieces are dealt by hash to shards of about ``per_shard`` pieces. Each shard starts from best fit in
decreasing order; then local search moves documents, and swaps one for one or two for one, from the
emptiest underfull bin into fuller ones. Each step raises the sum of squared fills, so it ends; a bin
that becomes empty goes, and a bin that can't be emptied is tried again after another one has gone. What stays in underfull bins of all shards is packed once more together.

Edge cases: null texts are empty documents of one token (the end id); repeated rows are packed as
separate documents; null doc_ids keep their rows; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowash.llm.common import tidy, write_stage
from foliowash.llm.tokens import default_vocabulary, encoder

CAPACITY = 4096
#: Bytes of text that a Python worker is sent at once; Spark's 10,000 rows are some 30 MB, held more than once on both sides.
AT_ONCE = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: only documents longer than ``capacity`` are cut, all pieces but the last full."""
    path = vocabulary or default_vocabulary()

    def cut(batches):
        for batch in batches:
            keys = batch.column(0)
            for i, j, ids, bounds in encoder(path).runs(batch.column(1)):
                size = np.diff(bounds)
                n = -(-size // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                data, at = memoryview(ids).cast("B"), (bounds[row] + start) * 4
                sums = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(cut), PIECES)


def best_fit(length: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in decreasing order: bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens of room
    for item in np.argsort(-length, kind="stable").tolist():
        n = int(length[item])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        room -= n
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins


def local_search(length: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties underfull bins, the emptiest first, by moves, one-for-one and two-for-one exchanges with fuller
    bins, until the fewest possible are left or none of them can be emptied."""
    least = -(-int(length.sum()) // capacity)
    failed: set[int] = set()
    fill = np.array([int(length[b].sum()) for b in bins], dtype=np.int64)
    live = np.ones(len(bins), dtype=bool)
    where = np.empty(len(length), dtype=np.int64)
    for k, b in enumerate(bins):
        where[b] = k
    while live.sum() > least:
        rank = np.where(live, fill, capacity)
        rank[list(failed)] = capacity
        donor = int(np.argmin(rank))
        if rank[donor] >= capacity:
            break
        others = np.flatnonzero(live[where] & (fill[where] < capacity) & (where != donor) & (fill[where] >= fill[donor]))
        bin_of, size = where[others], length[others]
        while bins[donor]:
            room = capacity - fill
            mine = bins[donor]
            # a document that fits elsewhere moves, to the bin it fits best
            moved = False
            spare = np.where(live & (fill >= fill[donor]), room, -1)
            spare[donor] = -1
            for item in sorted(mine, key=lambda x: -length[x]):
                ok = np.flatnonzero(spare >= length[item])
                if len(ok):
                    to = int(ok[np.argmin(spare[ok])])
                    mine.remove(item)
                    bins[to].append(item)
                    where[item] = to
                    fill[donor] -= length[item]
                    fill[to] += length[item]
                    moved = True
                    break
            if moved:
                others = np.flatnonzero(live[where] & (fill[where] < capacity) & (where != donor))
                bin_of, size = where[others], length[others]
                continue
            if not len(others):
                break
            limit, best, choice = room[bin_of], 0, None
            # equal lengths are as good as each other: one offer for each sum
            one = np.array(mine)
            i, j = np.triu_indices(len(one), 1)
            pairs, at = np.unique(length[one[i]] + length[one[j]], return_index=True)
            single, at_one = np.unique(length[one], return_index=True)
            offers = [(int(n), (mine[k],)) for n, k in zip(single, at_one, strict=True)]
            offers += [(int(n), (mine[i[k]], mine[j[k]])) for n, k in zip(pairs, at, strict=True)]
            for given, items in offers:
                gain = given - size
                gain[(gain > limit) | (bin_of == donor)] = 0
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, choice = int(gain[at]), (items, at)
            if choice is None:
                break
            items, at = choice
            back, to = int(others[at]), int(bin_of[at])
            bins[to].remove(back)
            bins[to].extend(items)
            bins[donor] = [x for x in mine if x not in items] + [back]
            where[list(items)], where[back] = to, donor
            fill[to] += best
            fill[donor] -= best
            others = np.flatnonzero(live[where] & (fill[where] < capacity) & (where != donor))
            bin_of, size = where[others], length[others]
        if bins[donor]:
            failed.add(donor)
        else:
            live[donor] = False
            failed.clear()
    return [b for b, keep in zip(bins, live.tolist(), strict=True) if keep]


def pack_lengths(length: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; full items stand alone."""
    full = np.flatnonzero(length >= capacity)
    rest = np.flatnonzero(length < capacity)
    bins = local_search(length[rest], best_fit(length[rest], capacity), capacity) if len(rest) else []
    return [[int(i)] for i in full] + [rest[b].tolist() for b in bins]


def pack(rows: DataFrame, capacity: int = CAPACITY, per_shard: int = 32768) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` column of 1 to ``capacity`` tokens."""
    columns = rows.columns
    # numbers that differ for equal rows too, so that no group of them is one shard's
    number = next(n for n in (f"number{k}" for k in range(len(columns) + 1)) if n not in columns)
    rows = write_stage(rows.withColumn(number, F.monotonically_increasing_id()), "pieces", spark_sql_execution_arrow_maxBytesPerBatch=str(AT_ONCE))
    count = rows.count()
    shards = max(1, -(-count // per_shard))

    def placed(first: int):
        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", *[c for c in columns if c != "length"]], kind="stable").reset_index(drop=True)
            length = pdf["length"].to_numpy(np.int64)
            bins = pack_lengths(length, capacity)
            sequence, offset, fill = (np.empty(len(pdf), np.int64) for _ in range(3))
            for k, b in enumerate(bins):
                sequence[b] = k
                offset[b] = np.cumsum(length[b]) - length[b]
                fill[b] = length[b].sum()
            base = (int(pdf["shard"].iloc[0]) + first) << 32
            return pdf[columns].assign(sequence_id=base + sequence, offset=offset, fill=fill)

        return place

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != number) + ", sequence_id long, offset long"
    result = schema + ", fill long"
    shard = lambda n: F.pmod(F.xxhash64(number), F.lit(n))
    one = rows.withColumn("shard", shard(shards)).groupBy("shard").applyInPandas(placed(0), result)
    if shards == 1:
        return one.drop("fill")
    one = write_stage(one, "packed")
    # a shard ends with a few underfull bins: those of all shards are packed again, in fewer shards
    edge = F.col("fill") < int(capacity * 0.98)
    left = one.where(edge)
    again = max(1, -(-left.count() // per_shard))
    two = left.select(*columns).withColumn(number, F.monotonically_increasing_id()).withColumn("shard", shard(again)).groupBy("shard").applyInPandas(placed(shards), result)
    return one.where(~edge).unionByName(two).drop("fill")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, per_shard: int = 32768) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity), capacity, per_shard)
