"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` rows by hash); every row is then put in a leaf. A query
walks the tree with a priority queue keyed by the inner product with a node's centre and what its spread
(root mean square of the sample's distances) may add, and
visits as many leaves as calibration asks for: for a few queries all rows are searched by brute force, and
visits are widened until the wanted share of true neighbours lies in the visited leaves. Leaves are grouped
in blocks of bounded size; rows move once per group of ``GROUP`` queries, so what moves grows with rows
times queries, and a query moves once per block that it visits.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
those of another length than most; a row never finds rows of its own vec_id; repeated rows are found once; fewer candidates than k give
all of them; ties go to the smaller vec_id; null vec_ids take no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowash.llm.common import tidy, write_stage
from foliowash.llm.vectors import dots, from_binary, matrix, of_common_size, to_binary, usable

SAMPLE, LEAF_ROWS, BRANCH, BLOCK_ROWS, GROUP = 20_000, 256, 8, 16_384, 2_048


@dataclass
class Tree:
    """Nodes in order of creation; children of inner nodes, a leaf number for leaves (else -1)."""

    centre: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by the nearest centre."""
        at = np.zeros(len(x), dtype=np.int64)
        while len(open_ := np.flatnonzero(self.leaf[at] < 0)):
            for node in np.unique(at[open_]):
                mine = open_[at[open_] == node]
                kids = self.children[node]
                c = self.centre[kids]
                at[mine] = np.array(kids)[np.argmin((c * c).sum(1)[None] - 2 * x[mine] @ c.T, axis=1)]
        return self.leaf[at]

    def best_first(self, q: np.ndarray, visits: int) -> np.ndarray:
        """Leaves of one query, most promising first."""
        bound = self.centre @ q + self.radius * np.linalg.norm(q)
        heap, out = [(-bound[0], 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            for kid in self.children[node]:
                heapq.heappush(heap, (-bound[kid], kid))
        return np.array(out, dtype=np.int32)


def fit_tree(x: np.ndarray, leaf_rows: float, branch: int = BRANCH, rounds: int = 8, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    centres, radii, children, leaf, todo, leaves = [], [], [], [], [], 0

    def add(rows: np.ndarray) -> int:
        c = x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1])
        centres.append(c)
        radii.append(float(np.sqrt(((x[rows] - c) ** 2).sum(1).mean())) if len(rows) else 0.0)
        children.append([])
        leaf.append(-1)
        todo.append((len(centres) - 1, rows))
        return len(centres) - 1

    add(np.arange(len(x)))
    while todo:
        node, rows = todo.pop()
        groups = []
        if len(rows) > max(leaf_rows, 2 * branch):
            means = x[rng.choice(rows, branch, replace=False)]
            for _ in range(rounds):
                near = np.argmin((means * means).sum(1)[None] - 2 * x[rows] @ means.T, axis=1)
                means = np.stack([x[rows[near == k]].mean(axis=0) if (near == k).any() else means[k] for k in range(branch)])
            groups = [rows[near == k] for k in range(branch) if (near == k).any()]
        if len(groups) < 2:
            leaf[node] = leaves
            leaves += 1
        else:
            children[node] = [add(g) for g in groups]
    return Tree(np.array(centres), np.array(radii), children, np.array(leaf))


def top(query: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of query, vec_id, score) of the k best of every query, own ids left out; ties to smaller ids."""
    rows, found, values = [], [], []
    for a in range(0, len(query), 256):
        s = query[a : a + 256] @ x.T
        s[own[a : a + 256, None] == ids[None]] = -np.inf
        n = min(k, len(ids))
        least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
        # scores within rounding of the k-th are compared again in an order of sums that is always the same
        i, j = np.nonzero((s >= least[:, None] - 1e-9 * (1 + np.abs(least[:, None]))) & (s > -np.inf))
        exact = dots(query[a + i], x[j])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        rows.append(a + i[keep])
        found.append(ids[j[keep]])
        values.append(exact[keep])
    return tuple(np.concatenate(v) if v else np.empty(0) for v in (rows, found, values))


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, audits: int = 64, column: str = "embedding", info: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product in double precision) for rows with ``is_query``.

    ``info`` receives the number of leaves, the visits and the recall that calibration measured.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(column)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows, size = of_common_size(rows, "v")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    n, n_queries = (int(x) for x in rows.agg(F.count(F.lit(1)), F.count_if("asks")).first())
    if not n_queries:
        return empty
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("tree"), "vec_id"), 11) / F.lit(float(1 << 53))
    sample = rows.where(unit < min(1.0, SAMPLE / n)).sort("vec_id").select("v").toArrow()
    x = matrix(sample["v"].combine_chunks(), size) if len(sample) else np.zeros((1, size))
    tree = fit_tree(x, LEAF_ROWS * max(1, len(x)) / n)

    def place(batches):
        for batch in batches:
            m = matrix(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tree.assign(m).astype(np.int32)), to_binary(m)], names=["vec_id", "asks", "leaf", "data"])

    placed = write_stage(rows.select("vec_id", "v", "asks").mapInArrow(tidy(place), "vec_id long, asks boolean, leaf int, data binary"), "leaves")
    visits, measured = calibrate(placed, tree, size, k, recall, audits, n_queries)
    if info is not None:
        info |= {"leaves": tree.leaves, "visits": visits, "recall": measured}
    # leaves in tree order fill blocks of bounded size; a leaf of more rows than that is cut in parts
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row a leaf: bounded by the sample
    block_of, parts, block, held = {}, {}, 0, 0
    for leaf in range(tree.leaves):
        have = counts.get(leaf, 0)
        if held and held + have > BLOCK_ROWS:
            block, held = block + 1, 0
        block_of[leaf], parts[leaf] = block, -(-have // BLOCK_ROWS)
        if have > BLOCK_ROWS:
            block, held = block + parts[leaf], 0
        else:
            held += have
    groups = max(1, -(-n_queries // GROUP))
    first, many = np.array([block_of[i] for i in range(tree.leaves)]), np.array([max(1, parts[i]) for i in range(tree.leaves)])

    def deal_rows(batches):
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cell = first[leaf] + ids % many[leaf]
            for g in range(groups):
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.full(len(ids), g, np.int32)), batch.column(0), batch.column(1), batch.column(2)], names=["block", "group", "vec_id", "leaf", "data"])

    def deal_queries(batches):
        for batch in batches:
            q = from_binary(batch.column(1).to_pylist(), size)
            cells, who, visited = [], [], []
            for i, v in enumerate(q):
                leaves = tree.best_first(v, visits)
                for part in range(int(many[leaves].max())):
                    mine = leaves[many[leaves] > part]
                    block = first[mine] + part
                    for b in np.unique(block):
                        cells.append(b)
                        who.append(i)
                        visited.append(mine[block == b].tolist())
            who = np.array(who, dtype=np.int64)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array((ids[who] // 20 % groups).astype(np.int32) if len(who) else [], pa.int32()), pa.array(ids[who]), pa.array(visited, pa.list_(pa.int32())), batch.column(1).take(pa.array(who))], names=["block", "group", "query_id", "leaves", "data"])

    def answer(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asks):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        data = data.drop_duplicates(["vec_id", "data"]).sort_values(["leaf", "vec_id"])  # repeated rows share a leaf
        x, ids, leaf = from_binary(data["data"], size), data["vec_id"].to_numpy(np.int64), data["leaf"].to_numpy()
        q, own = from_binary(asks["data"], size), asks["query_id"].to_numpy(np.int64)
        asked = np.concatenate([np.asarray(v, dtype=np.int64) for v in asks["leaves"]])
        by = np.repeat(np.arange(len(asks)), [len(v) for v in asks["leaves"]])
        got = []
        for one in np.unique(asked):
            a, b = np.searchsorted(leaf, one), np.searchsorted(leaf, one, "right")
            if a < b:
                mine = by[asked == one]
                i, found, value = top(q[mine], own[mine], x[a:b], ids[a:b], k)
                got.append((mine[i], found, value))
        who, found, value = (np.concatenate(v) for v in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 3
        order = np.lexsort((found, -value, who))
        who, found, value = who[order], found[order], value[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        return pd.DataFrame({"query_id": own[who[keep]], "vec_id": found[keep].astype(np.int64), "score": value[keep].astype(float)})

    dealt = placed.select("vec_id", "leaf", "data").mapInArrow(deal_rows, "block int, group int, vec_id long, leaf int, data binary")
    asked = placed.where("asks").select("vec_id", "data").mapInArrow(deal_queries, "block int, group int, query_id long, leaves array<int>, data binary")
    found = dealt.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(answer, "query_id long, vec_id long, score double")
    # a query may come from repeated rows; each (query, vector) pair counts once
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(placed: DataFrame, tree: Tree, size: int, k: int, recall: float, audits: int, n_queries: int) -> tuple[int, float]:
    """Leaf visits for the wanted recall over ``audits`` queries, by brute force over all rows in blocks."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("audit"), "vec_id"), 11) / F.lit(float(1 << 53))
    chosen = placed.where("asks").where(unit < min(1.0, 2 * audits / n_queries)).orderBy("vec_id").limit(audits).select("vec_id", "data").toArrow()
    if not len(chosen):
        return tree.leaves, 1.0
    q, own = from_binary(chosen["data"].to_pylist(), size), chosen["vec_id"].to_numpy()

    def scan(batches):
        for batch in batches:
            x = from_binary(batch.column(2).to_pylist(), size)
            ids, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            i, found, value = top(q, own, x, ids, k)
            at = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(found.astype(np.int64)), pa.array(value.astype(float)), pa.array([at[v] for v in found.tolist()], pa.int32())], names=["q", "vec_id", "score", "leaf"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = placed.select("vec_id", "leaf", "data").mapInArrow(scan, "q int, vec_id long, score double, leaf int").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "leaf").toPandas()
    rank = np.empty(len(true), dtype=np.int64)
    for i in range(len(q)):
        order = np.empty(tree.leaves, dtype=np.int64)
        order[tree.best_first(q[i], tree.leaves)] = np.arange(tree.leaves)
        mine = true["q"].to_numpy() == i
        rank[mine] = order[true["leaf"].to_numpy()[mine]]
    share = np.cumsum(np.bincount(rank, minlength=tree.leaves)) / max(1, len(rank))
    visits = int(np.searchsorted(share, recall)) + 1
    return min(visits, tree.leaves), float(share[min(visits, tree.leaves) - 1])
