"""Quality by a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and cover all of it.
In a chunk, each byte has a learned vector; learned filters over ``WIDTH`` bytes run along it at every
place, are rectified and max-pooled over the chunk, and a linear layer gives the chunk's log-odds; the
document's log-odds are the mean over its chunks, weighted by their bytes. Since a filter is linear in the
byte vectors, scoring uses one table row per byte and filter tap, so it gathers rows and adds them.

Learning uses at most about ``max_docs`` labelled documents a class, chosen by a hash of the doc_id, and
``chunks_each`` chunks of each per epoch (documented bounds), with Adam on the driver. The network's
log-odds are then calibrated (Platt) on documents kept out of learning.

Edge cases: null and empty texts are one chunk of no bytes (pooled values zero); repeated rows get equal
scores; null doc_ids are scored, with a null fold; without labels of both classes the score is the share
of label 1, or 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foliowash.llm.bytewords import arrow_bytes, slices
from foliowash.llm.common import fold, quoted, tidy, write_stage
from foliowash.llm.toxicity import THRESHOLD, chosen_labels, platt

MAX_DOCS = 3000
CHUNK, OVERLAP, WIDTH, FILTERS, DIM = 512, 64, 4, 16, 8


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray  # (WIDTH, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    tables: np.ndarray | None = field(default=None, repr=False)

    def prepare(self) -> Network:
        """Tables by byte, or by pair of bytes, in place of byte vectors times filter taps."""
        taps = np.einsum("bd,wdf->wbf", self.embed, self.filters).astype(np.float32)
        pairs = taps[0::2, :, None, :] + taps[1::2, None, :, :]
        self.tables = np.ascontiguousarray(pairs.reshape(WIDTH // 2, 65536, FILTERS))
        return self

    def pooled(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filter values of the chunks [start, end) of ``data``."""
        out = np.zeros((len(start), FILTERS), dtype=np.float32)
        a = 0
        while a < len(start):  # chunks in groups that fit a small buffer
            b = a + max(1, int(np.searchsorted(end[a:], start[a] + (1 << 16), "right")))
            lo, hi = int(start[a]), int(end[b - 1])
            piece = data[lo:hi].astype(np.int32)
            if len(piece) >= WIDTH:
                pair = piece[:-1] * 256 + piece[1:]
                n = len(piece) - WIDTH + 1
                value = self.tables[0][pair[:n]]
                for k in range(1, WIDTH // 2):
                    value += self.tables[k][pair[2 * k : 2 * k + n]]
                s, e = start[a:b] - lo, end[a:b] - lo - WIDTH + 1
                fine = np.flatnonzero(e > s)
                if len(fine):
                    s, e = s[fine], np.minimum(e[fine], n)
                    # chunks overlap, so odd and even ones are reduced apart
                    for half in (slice(0, None, 2), slice(1, None, 2)):
                        s2, e2 = s[half], e[half]
                        if len(s2):
                            bounds = np.stack([s2, e2], axis=1).ravel()
                            top = np.maximum.reduceat(np.concatenate([value, value[-1:]]), bounds, axis=0)[0::2]
                            out[a + fine[half]] = np.maximum(top + self.bias, 0)
            a = b
        return out

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        result = np.empty(len(texts))
        for i, j in slices(texts, 4 << 20):
            data, offsets = arrow_bytes(texts[i:j])
            start, end, doc = chunks(offsets)
            value = self.pooled(data, start, end) @ self.out + self.out_bias
            size = np.maximum(1, end - start)
            result[i:j] = np.bincount(doc, value * size, j - i) / np.bincount(doc, size, j - i)
        return self.slope * result + self.offset


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks that cover every text whole: start, end, and number of the text."""
    size, step = np.diff(offsets), CHUNK - OVERLAP
    n = np.maximum(1, -(-(size - OVERLAP) // step))
    doc = np.repeat(np.arange(len(size)), n)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
    return start, np.minimum(start + CHUNK, offsets[1:][doc]), doc


def _forward(net, x, size):
    """x: (chunks, CHUNK) bytes, of which the first ``size`` count. Pooled values and places of the maxima."""
    e = net["embed"][x]
    n = x.shape[1] - WIDTH + 1
    columns = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), n, WIDTH * DIM)
    value = columns @ net["filters"].reshape(WIDTH * DIM, FILTERS)
    value[np.arange(n)[None, :] > (size - WIDTH)[:, None]] = -np.inf
    place = value.argmax(axis=1)
    top = np.take_along_axis(value, place[:, None, :], axis=1)[:, 0] + net["bias"]
    return np.maximum(top, 0), top, place


def fit(texts: list[bytes], label: np.ndarray, weight: np.ndarray, epochs: int = 12, chunks_each: int = 4, batch: int = 64, rate: float = 0.01, short: float = 0.3, seed: int = 5) -> Network:
    """Adam on the weighted logistic loss of single chunks that bear their document's label."""
    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "filters": rng.normal(0, 0.3, (WIDTH, DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.3, FILTERS).astype(np.float32), "out_bias": np.zeros(1, np.float32),
    }
    first, second, step = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2)), 0, 0
    first, second = first
    pool = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    for _ in range(epochs):
        picks = []
        for d, t in enumerate(pool):
            if len(t) >= WIDTH:
                at = rng.integers(0, max(1, len(t) - CHUNK + 1), chunks_each if len(t) > CHUNK else 1)
                picks += [(d, int(a)) for a in at]
        order = rng.permutation(len(picks))
        for k in range(0, len(order), batch):
            rows = [picks[i] for i in order[k : k + batch]]
            # some chunks are cut short, so that short texts and last chunks are learned too
            cut = np.where(rng.random(len(rows)) < short, rng.integers(16, 200, len(rows)), CHUNK)
            x, size = np.zeros((len(rows), CHUNK), np.uint8), np.empty(len(rows), np.int64)
            for r, (d, a) in enumerate(rows):
                piece = pool[d][a : a + int(cut[r])]
                x[r, : len(piece)], size[r] = piece, len(piece)
            d = np.array([r[0] for r in rows])
            hidden, top, place = _forward(net, x, size)
            p = 1 / (1 + np.exp(-(hidden @ net["out"] + net["out_bias"])))
            g = ((p - label[d]) * weight[d] / len(d)).astype(np.float32)
            grad = {"out": hidden.T @ g + 1e-4 * net["out"], "out_bias": np.array([g.sum()], np.float32)}
            inner = g[:, None] * net["out"] * (top > 0)
            grad["bias"] = inner.sum(axis=0)
            grad["filters"], grad["embed"] = np.zeros_like(net["filters"]), np.zeros_like(net["embed"])
            for w in range(WIDTH):
                seen = np.take_along_axis(x, place + w, axis=1)  # the byte under each filter's maximum
                vectors = net["embed"][seen]
                grad["filters"][w] = np.einsum("bfd,bf->df", vectors, inner)
                back = inner[:, :, None] * net["filters"][w].T[None]
                np.add.at(grad["embed"], seen.ravel(), back.reshape(-1, DIM))
            step += 1
            for name, v in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.999 * second[name] + 0.001 * v * v
                net[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(net["embed"], net["filters"], net["bias"], net["out"], float(net["out_bias"][0])).prepare()


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", max_docs: int = MAX_DOCS, excerpt: int = 16 * CHUNK, **options) -> Network:
    """The driver gets at most ``2 * max_docs`` documents, of longer ones ``excerpt`` bytes from chunks all
    over the text (learning only; scoring reads whole texts)."""
    picked, sizes = chosen_labels(labels, column, max_docs)
    joined = docs.select("doc_id", "text").join(picked, "doc_id")

    def cut(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                data = (text or "").encode()
                if len(data) > excerpt:
                    at = np.linspace(0, len(data) - CHUNK, excerpt // CHUNK).astype(int).tolist()
                    data = b"".join(data[a : a + CHUNK] for a in at)
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["label", "fit", "data"])

    rows = joined.select("label", F.col("count_part").alias("fit"), "text", "doc_id").sort("doc_id").drop("doc_id").mapInArrow(cut, "label int, fit boolean, data binary").toArrow()
    y, part = rows["label"].to_numpy(), rows["fit"].to_numpy().astype(bool)
    texts = rows["data"].to_pylist()
    total = sum(sizes.values())
    share = {c: sizes.get(c, 0) / total for c in (0, 1)} if total else {0: 1.0, 1: 0.0}
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        flat = Network(np.zeros((256, DIM), np.float32), np.zeros((WIDTH, DIM, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0, 0.0, float(np.log(max(share[1], 1e-12) / max(share[0], 1e-12))))
        return flat.prepare()
    even = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    net = fit([t for t, f in zip(texts, part, strict=True) if f], y[part].astype(np.float32), even[part].astype(np.float32), **options)
    held = [t for t, f in zip(texts, part, strict=True) if not f]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in held])])
    start, end, doc = chunks(bounds)
    value = net.pooled(np.frombuffer(b"".join(held), dtype=np.uint8), start, end) @ net.out + net.out_bias
    size = np.maximum(1, end - start)
    x = np.bincount(doc, value * size, len(held)) / np.bincount(doc, size, len(held))
    weight = np.array([share[int(c)] / max(1e-9, (y[~part] == c).mean()) for c in y[~part]])
    net.slope, net.offset = platt(x, y[~part], weight)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(net.log_odds(batch.column(1)), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """Learns from labelled documents outside the held-out fold and scores all: doc_id, held_out, score, predicted."""
    net = train(docs, labels.where(fold(F.col("doc_id"), folds) != held), **options)
    return score(docs, net).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; all columns and repeated rows stay."""
    net = train(docs, labels.where(fold(F.col("doc_id"), folds) != held), **options)

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(net.log_odds(batch.column(1)), -700, 700)))
            yield batch.filter(pa.array(p >= least)).select([0])

    rows = docs.select(F.struct(*quoted(docs)).alias("input"), "text")
    kept = rows.mapInArrow(tidy(run), StructType([StructField("input", docs.schema)]))
    return kept.select(*[F.col("input").getField(c).alias(c) for c in docs.columns])
