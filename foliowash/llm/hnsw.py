"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Vectors of one label are dealt over shards of about ``SHARD_ROWS``; each shard gets a graph of its own,
stored as one binary row. Every vector of the label queries every shard of it. Searches run for many
queries at once: a beam is widened while even its last member is a link, and for the whole cell until a
recall audit against brute force (of so many queries that ``AUDITS`` links, or half the cell, are seen) passes. Every reported link's cosine is
verified in double precision. A cell returns each query's number of links and a spanning forest of the
links, not the links themselves, so a group of n near copies makes n rows. Exact copies are one class with
a count, and components are united at the end.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, rows with a null
label, and vectors of another length than most link with nothing: n_links 0, component their own vec_id,
kept. Repeated rows with one vec_id are different vectors that share a component. Rows with a null vec_id
take no part and have null component and kept. An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowash.llm.common import components, tidy, write_stage
from foliowash.llm.simhash import forest
from foliowash.llm.vectors import dots, from_binary, matrix, of_common_size, to_binary, usable

THRESHOLD, SHARD_ROWS, QUERY_ROWS, AUDITS = 0.98, 6_144, 2_048, 64
_M, _MOST, _BUILD_BEAM, _BEAM = 12, 24, 32, 16


class Graph:
    """Layered graph over unit vectors; node order is by level, so a layer is a prefix of the nodes."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers
        self.x32 = x.astype(np.float32)

    @classmethod
    def build(cls, x: np.ndarray, level: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The graph and the order in which it holds the rows of ``x``."""
        order = np.argsort(-level, kind="stable")
        level = level[order]
        self = cls(x[order], [])
        sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
        # the top layer is small enough to look through
        while len(sizes) > 1 and sizes[-1] < 32:
            sizes.pop()
        self.layers = [np.empty((0, _MOST), np.int32) for _ in sizes]
        for k in range(len(sizes) - 1, -1, -1):
            self._grow(k, sizes[k])
        return self, order

    def _grow(self, layer: int, n: int) -> None:
        """Inserts the first n nodes into a layer, in batches that at most double it."""
        links = np.full((n, _MOST), -1, dtype=np.int32)
        self.layers[layer] = links[:0]
        # nodes of the layer above come first, linked by comparing all of them
        have = min(n, max(64, len(self.layers[layer + 1]) if layer + 1 < len(self.layers) else 0))
        self._link(links, np.arange(have), np.arange(have)[None].repeat(have, 0), self.x32[:have] @ self.x32[:have].T)
        while have < n:
            more = min(n, have + min(have, 512))
            self.layers[layer] = links[:have]
            ids, sims = self.search(self.x32[have:more], _BUILD_BEAM, layer)
            new = np.arange(have, more)
            # nodes of the same batch may be each other's neighbours
            inner = self.x32[new] @ self.x32[new].T
            near = np.argsort(-inner, axis=1)[:, : min(len(new), _M + 1)]
            self._link(links, new, np.concatenate([ids, new[near]], axis=1), np.concatenate([sims, np.take_along_axis(inner, near, axis=1)], axis=1))
            have = more
        self.layers[layer] = links

    def _link(self, links: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, sims: np.ndarray) -> None:
        """Chooses diverse neighbours for new nodes and adds the links back, the nearest first."""
        sims = np.where((candidates < 0) | (candidates == nodes[:, None]), -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * _M]
        candidates, sims = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sims, order, axis=1)
        chosen = np.zeros(candidates.shape, dtype=bool)
        n_chosen = np.zeros(len(nodes), dtype=np.int64)
        vectors = self.x32[candidates]
        closest = np.full(candidates.shape, -np.inf, dtype=np.float32)  # similarity to the nearest chosen one
        for c in range(candidates.shape[1]):
            take = (sims[:, c] > -np.inf) & (closest[:, c] < sims[:, c]) & (n_chosen < _M)
            chosen[:, c] = take
            n_chosen += take
            if take.any():
                near = np.einsum("bcd,bd->bc", vectors[take], vectors[take, c])
                closest[take] = np.maximum(closest[take], near)
        # the nearest of the others fill up, so that near copies stay linked
        rest = ~chosen & (sims > -np.inf)
        fill = rest & (np.cumsum(rest, axis=1) <= (_M - n_chosen)[:, None])
        a, c = np.nonzero(chosen | fill)
        a, b, s = nodes[a], candidates[a, c], sims[a, c]
        src, dst, sim = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        old_rows = np.unique(src)
        old = links[old_rows]
        r, c = np.nonzero(old >= 0)
        src, dst = np.concatenate([src, old_rows[r]]), np.concatenate([dst, old[r, c]])
        sim = np.concatenate([sim, np.einsum("nd,nd->n", self.x32[old_rows[r]], self.x32[old[r, c]])])
        key, first = np.unique(src.astype(np.int64) << 32 | dst, return_index=True)
        src, dst, sim = src[first], dst[first], sim[first]
        order = np.lexsort((-sim, src))
        src, dst = src[order], dst[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        keep = place < _MOST
        links[old_rows] = -1
        links[src[keep], place[keep]] = dst[keep]

    def search(self, q: np.ndarray, beam: int, layer: int = 0, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, similarities), best first, -1 where there are fewer."""
        out_i, out_s = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
        for a in range(0, len(q), block):
            part = q[a : a + block]
            upper = [k for k in range(len(self.layers) - 1, layer, -1)]
            n_top = len(self.layers[upper[0]]) if upper else min(len(self.layers[layer]), 64)
            s = part @ self.x32[:n_top].T
            n = min(n_top, 4)
            entry = np.argpartition(-s, n - 1, axis=1)[:, :n]
            for k in [*upper[1:], layer]:
                ids, sims = self._beam(part, entry, 4 if k > layer else beam, k)
                entry = ids
            if not upper and not len(self.layers[layer]):
                continue
            w = min(beam, ids.shape[1])
            out_i[a : a + block, :w], out_s[a : a + block, :w] = ids[:, :w], sims[:, :w]
        return out_i, out_s

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        links, n = self.layers[layer], len(self.layers[layer])
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), dtype=bool)
        entry = np.where(entry < 0, n, entry)
        ids = np.full((len(q), beam), n, np.int64)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        opened = np.zeros((len(q), beam), dtype=bool)
        w = min(beam, entry.shape[1])
        ids[:, :w] = entry[:, :w]
        sims[:, :w] = np.where(ids[:, :w] < n, np.einsum("bmd,bd->bm", self.x32[np.minimum(ids[:, :w], n - 1)], q), -np.inf)
        seen[rows, ids[:, :w]] = True
        live = np.arange(len(q))
        while len(live):
            score = np.where(opened[live] | (ids[live] == n), -np.inf, sims[live])
            best = np.argsort(-score, axis=1)[:, :step]
            good = np.take_along_axis(score, best, axis=1) > -np.inf
            some = good.any(axis=1)
            live, best, good = live[some], best[some], good[some]
            if not len(live):
                break
            at = live[:, None]
            opened[at, best] |= good
            near = links[np.where(good, ids[at, best], 0)].astype(np.int64)
            near[~good] = -1
            near = near.reshape(len(live), -1)
            near[near < 0] = n
            # the same neighbour of two opened members counts once
            order = np.argsort(near, axis=1, kind="stable")
            near = np.take_along_axis(near, order, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[at, near]] = n
            seen[at, near] = True
            fresh = np.where(near < n, np.einsum("bmd,bd->bm", self.x32[np.minimum(near, n - 1)], q[live]), -np.inf)
            all_i, all_s = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], fresh], axis=1)
            all_o = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], opened[live] = (np.take_along_axis(v, keep, axis=1) for v in (all_i, all_s, all_o))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        ids[ids == n] = -1
        return ids, sims

    def within(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, node) of all found with a cosine of at least the threshold, verified in double precision.

        A query whose whole beam consists of links is searched again with twice the beam. Nodes that none
        of their nearest neighbours links back to are hard to reach, so all queries look at them.
        """
        links = self.layers[0]
        near = links[:, : min(3, links.shape[1])]
        back = (links[np.maximum(near, 0)] == np.arange(len(links))[:, None, None]).any(axis=2) & (near >= 0)
        loose = ~back.any(axis=1)
        hard = np.flatnonzero(loose)
        q32, todo, got_q, got_n = q.astype(np.float32), np.arange(len(q)), [], []
        while len(todo):
            wide = min(beam, len(self.x))
            block = max(1, min(256, (1 << 21) // max(1, wide * 64)))
            ids, sims = self.search(q32[todo], wide, block=block)
            full = (sims[:, -1] >= threshold - 1e-4) & (wide < len(self.x))
            i, c = np.nonzero((sims >= threshold - 1e-4) & ~full[:, None] & (ids >= 0) & ~loose[np.maximum(ids, 0)])
            node, row = ids[i, c], todo[i]
            true = dots(q[row], self.x[node]) >= threshold
            got_q.append(row[true])
            got_n.append(node[true])
            todo, beam = todo[full], beam * 2
        for a in range(0, len(q) if len(hard) else 0, 512):
            i, c = np.nonzero(q32[a : a + 512] @ self.x32[hard].T >= threshold - 1e-4)
            true = dots(q[a + i], self.x[hard[c]]) >= threshold
            got_q.append(a + i[true])
            got_n.append(hard[c[true]])
        return (np.concatenate(got_q), np.concatenate(got_n)) if got_q else (np.empty(0, np.int64),) * 2

    def audited(self, q: np.ndarray, threshold: float, beam: int = _BEAM, audits: int = AUDITS, least: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
        """``within``, with beams widened until a sample of queries misses at most 1 % of its links. The sample
        grows until it holds ``audits`` links or is half of all queries; a cell whose sample has none is searched
        with a beam four times as wide."""
        true, size = 0, audits
        while true < audits:
            pick = np.unique(np.linspace(0, len(q) - 1, min(size, len(q))).astype(int))
            true = sum(int((q[pick[a : a + 512]] @ self.x.T >= threshold).sum()) for a in range(0, len(pick), 512))
            if 2 * len(pick) >= len(q):
                break
            size *= 4
        beam *= 1 if true else 4
        while beam < len(self.x):
            if len(self.within(q[pick], threshold, beam)[0]) >= least * true:
                return self.within(q, threshold, beam)
            beam *= 2
        found = [np.nonzero(q[a : a + 512] @ self.x.T >= threshold) for a in range(0, len(q), 512)]
        return np.concatenate([a * 512 + i for a, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def levels(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the ids, so rebuilding gives the same graph."""
    from foliowash.llm.bytewords import mix

    u = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.floor(-np.log(1 - u) / np.log(_M)).astype(np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    part = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(column))
    part = part.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(column).cast("array<double>").alias("v"))
    part, size = of_common_size(part, "v")
    everyone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    result = lambda d: d.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    if not size:
        return result(everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))

    def unit(batches):
        for batch in batches:
            m = matrix(batch.column(2), size)
            m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow of very large components
            m /= np.sqrt(dots(m, m))[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), to_binary(m)], names=["vec_id", "label", "u"])

    label = vectors.schema["label"].dataType.simpleString()
    units = write_stage(part.mapInArrow(tidy(unit), f"vec_id long, label {label}, u binary"), "units")
    # exact copies are one class; salting first keeps a class of very many copies out of one task
    salted = units.groupBy("label", "u", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = salted.groupBy("label", "u").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"))
    plan = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    classes = write_stage(classes.join(plan, "label").withColumn("shard", F.pmod(F.xxhash64("rep", "u"), F.col("shards")).cast("int")), "classes")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "u"])
        x, reps = from_binary(pdf["u"], size), pdf["rep"].to_numpy(np.int64)
        graph, order = Graph.build(x, levels(reps))
        links = b"".join([np.array([len(graph.layers), *map(len, graph.layers)], "<i8").tobytes(), *[v.astype("<i4").tobytes() for v in graph.layers]])
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "shard": [int(pdf["shard"].iloc[0])], "parts": [int(pdf["parts"].iloc[0])], "reps": [reps[order].tobytes()], "copies": [pdf["copies"].to_numpy(np.int64)[order].tobytes()], "vectors": [graph.x.tobytes()], "links": [links]})

    graphs = write_stage(classes.groupBy("label", "shard").applyInPandas(build, f"label {label}, shard int, parts int, reps binary, copies binary, vectors binary, links binary"), "graphs")
    asked = classes.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "rep", "u"), F.col("parts")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    there = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def answer(graph: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(asks):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "u": pd.Series(dtype="object")})
        row = graph.iloc[0]
        reps, copies = np.frombuffer(row["reps"], "<i8"), np.frombuffer(row["copies"], "<i8")
        n_layers = int(np.frombuffer(row["links"], "<i8", 1)[0])
        sizes = np.frombuffer(row["links"], "<i8", n_layers, 8)
        flat = np.frombuffer(row["links"], "<i4", offset=8 * (n_layers + 1)).reshape(-1, _MOST)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        g = Graph(from_binary([row["vectors"]], size), [flat[bounds[k] : bounds[k + 1]] for k in range(n_layers)])
        own = asks["rep"].to_numpy(np.int64)
        i, node = g.audited(from_binary(asks["u"], size), threshold)
        n = np.bincount(i, copies[node], len(own)).astype(np.int64)
        # a forest over the ids that meet here, in order of id
        names, at = np.unique(np.concatenate([own[i], reps[node]]), return_inverse=True)
        label = forest(len(names), at[: len(i)], at[len(i) :])
        far = np.flatnonzero(label != np.arange(len(names)))
        counts = pd.DataFrame({"a": own, "b": pd.array([None] * len(own), "Int64"), "n": n, "u": asks["u"].to_numpy()})
        edges = pd.DataFrame({"a": names[far], "b": pd.array(names[label[far]], "Int64"), "n": np.zeros(len(far), np.int64), "u": [b""] * len(far)})
        return pd.concat([counts[counts["n"] > 0], edges])

    keys = ["label", "shard", "part"]
    found = there.groupBy(*keys).cogroup(asked.select(*keys, "rep", "u").groupBy(*keys)).applyInPandas(answer, "a long, b long, n long, u binary")
    found = write_stage(found, "found")
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep"), "u").agg(F.sum("n").alias("n"))
    of = classes.select("label", "u", "rep").join(counts, ["rep", "u"], "left").join(joined, F.col("rep") == F.col("node"), "left")
    of = of.select("label", "u", (F.coalesce("n", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = units.join(of, ["label", "u"], "left").select("vec_id", "n_links", "component_id")
    taken = linked.where("component_id IS NOT NULL").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return result(everyone.join(taken, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
