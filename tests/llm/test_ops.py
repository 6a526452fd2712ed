import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliowash.llm import hnsw, linededup, lm, mixing, neighbours, packing, quality, repair, simhash, tokens, toxicity
from foliowash.llm.bytewords import words
from foliowash.llm.common import components
from foliowash.llm.eliasfano import EliasFano
from foliowash.llm.tokens import default_vocabulary, encoder
from tests.oracle import connect, differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
ODD = [None, "", "   ", "a", "Hello  WORLD\ta", "É é ß", "<|endoftext|> x", "x " * 3000, "same text here", "same text here", "q\nq\n\nq"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", ["a", "b", None][k % 3], 0) for k, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "a", "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def split(t):
    return WORD.findall(t.translate(LOWER))


def test_words_match_the_pattern():
    w = words(pa.array(ODD))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in ODD for x in split(t or "")]
    h = w.hashes()
    assert len(set(h.tolist())) == len({x for t in ODD for x in split(t or "")})


def test_encoder_equals_the_library():
    e = encoder(default_vocabulary())
    ids, b = e.encode(pa.array(ODD))
    for i, t in enumerate(ODD):
        assert ids[b[i] : b[i + 1]].tolist() == e.library.encode(t or "", add_special_tokens=False).ids + [1]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1, 10), (500, 600), (2000, 1 << 40), (3000, 1 << 12)):
        v = np.sort(rng.integers(0, u, n)).astype(np.uint64)
        x = np.concatenate([v, rng.integers(0, u, 1000).astype(np.uint64)])
        at, same = EliasFano.encode(v, u).successor(x)
        assert (at == np.searchsorted(v, x)).all() and (same == np.isin(x, v)).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4)] + [(100, k) for k in range(101, 140)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got[3] == 1 and got[11] == 10 and got[139] == 100 and 5 not in got


def test_packing(docs, odd, spark):
    for df in (docs, odd):
        rows = packing.pack_documents(df).toPandas()
        assert len(rows.dropna(subset=["doc_id"])) >= df.where("doc_id IS NOT NULL").count()
        for _, g in rows.sort_values("offset").groupby("sequence_id"):
            assert (g["offset"].to_numpy() == np.cumsum(g["length"].to_numpy()) - g["length"].to_numpy()).all() and g["length"].sum() <= 4096
        bound = -(-int(rows["length"].sum()) // 4096)
        assert rows["sequence_id"].nunique() <= bound + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0
    many = packing.pack(spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(1800)) + 1).alias("length")), per_shard=500).toPandas()
    assert many["sequence_id"].nunique() <= -(-int(many["length"].sum()) // 4096) + 2 and len(many) == 3000


def test_local_search_never_adds_bins():
    rng = np.random.default_rng(1)
    for _ in range(5):
        n = rng.integers(1, 3000, 400)
        first = packing.best_fit(n, 4096)
        after = packing.local_search(n, [list(b) for b in first], 4096)
        assert len(after) <= len(first) and sorted(x for b in after for x in b) == list(range(400)) and max(n[b].sum() for b in after) <= 4096


def test_simhash_against_brute_force(docs, odd):
    for df in (docs, odd.where("doc_id IS NOT NULL")):
        want = {}
        for r in df.select("doc_id", "text").collect():
            w = split(r["text"] or "")
            sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
            h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
            want[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        got = simhash.near_duplicates(df).toPandas()
        ids = sorted(want)
        low = {i: i for i in ids}
        changed = True
        while changed:
            changed = False
            for i in ids:
                for j in ids:
                    if (want[i] ^ want[j]).bit_count() <= 2 and low[i] < low[j]:
                        low[j], changed = low[i], True
        for r in got.itertuples():
            assert r.fp % 2**64 == want[r.doc_id] and r.component_id == low[r.doc_id]
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_trie_join_with_larger_budgets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    v = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), base ^ np.uint64(0b1011001)]))
    for errors in (1, 2, 6):
        i, j = simhash.trie_join(v, errors)
        want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= errors}
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_keep_one(docs, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [r["text"] for r in kept.collect()]
    assert rows.count("same text here") == 1 and rows.count("a") == 1 and "no id" in rows


def test_keep_one_against_brute_force(spark, odd):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(int(rng.integers(30, 300)))]
        for rate in (0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06):
            rows.append(" ".join(w if rng.random() >= rate else f"z{rng.integers(10**6)}" for w in base))
    rows = [rows[k] for k in rng.permutation(len(rows))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    low = list(range(len(rows)))
    for _ in rows:
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(rows)], odd.schema)
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept == {k for k in range(len(rows)) if low[k] == k} and 40 < len(kept) < len(rows)


def brute_lines(df):
    rows = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None and r["text"] is not None)
    seen, gone = [], set()
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            s = {w for w in re.split(r"[ \t\v\f\r]+", line.lower()) if w}
            if s:
                if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for _, o in seen):
                    gone.add((i, k))
                seen.append(((i, k), s))
    return gone


def test_line_dedup_against_brute_force(docs, odd, spark):
    noise = np.random.default_rng(3)
    base = [f"w{k}" for k in range(40)]
    near = [(k, " ".join(w if noise.random() > 0.06 else f"z{noise.integers(99)}" for w in base), "en", "s", 0) for k in range(60)]
    for df in (docs, odd, spark.createDataFrame(near, odd.schema)):
        assert {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(df).collect()} == brute_lines(df)
    out = linededup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == odd.count()
    assert out.where("doc_id = 0").first()["text"] is None
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_token_blocks(docs, odd):
    e = encoder(default_vocabulary()).library
    for df in (docs, odd):
        got = repair.read(repair.write(df, block_ids=20_000, shards=3)).toPandas()
        assert len(got) == df.count()
        start = 0
        got = got.sort_values("start")
        for r in got.itertuples():
            assert r.start == start
            start += r.n_tokens
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            want[(r["doc_id"], zlib.crc32(np.array(e.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))] += 1
        assert collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.ids_crc32) for r in got.itertuples()) == want
    assert repair.read(repair.write(docs.limit(0))).count() == 0


def test_random_access():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 30, 20_000).astype(np.uint32)
    bounds = np.unique(np.concatenate([[0, 20_000], rng.integers(0, 20_000, 200)]))
    n = len(bounds) - 1
    packed = repair.compress(ids, bounds, first=100)
    b = repair.Block(repair.to_bytes(np.arange(n), np.zeros(n, bool), bounds, packed))
    assert len(b.symbols) < len(ids) and len(b.rules) > 0
    for k in range(n):
        assert (b.document(k) == ids[bounds[k] : bounds[k + 1]]).all()
    for k in range(0, len(b.rules), 7):
        assert len(repair.expand(np.array([b.first + k], np.uint32), b.rules, b.first)) == b.rule_sizes[k]


def test_mixing(docs, odd):
    m = mixing.mix(docs).toPandas()
    assert (m["taken"] <= 2 * m["size"]).all()
    by = m.groupby(docs.select("doc_id", "source").toPandas().set_index("doc_id")["source"].reindex(m["doc_id"]).to_numpy())
    for _, g in by:
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
        assert g["target"].iloc[0] <= 2 * g["source_size"].iloc[0] + 1e-6
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns and rows.count() == (m["taken"] // m["size"].clip(lower=1)).sum() + rows.join(m_zero(docs), "doc_id", "left_semi").count()
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0


def m_zero(docs):
    return docs.where(F.coalesce(F.trim("text"), F.lit("")) == "").select("doc_id")


def test_mixing_oracle(spark, sf_dir):
    from foliowash.llm.queries import ORACLES, QUERIES

    assert differences(QUERIES["op10_mixing"](spark, sf_dir), connect(sf_dir), ORACLES["op10_mixing"]) == ""


def test_classifiers(docs, labels, odd):
    for run, column in ((toxicity.toxicity, "toxic"), (quality.quality, "quality")):
        got = run(docs, labels).toPandas()
        assert len(got) == docs.count() and got["score"].between(0, 1).all()
        assert all(bool(r.held_out) == (zlib.crc32(str(r.doc_id).encode()) % (3 if column == "toxic" else 4) == (1 if column == "toxic" else 2)) for r in got.itertuples())
        assert run(docs.unionByName(odd), labels).count() == docs.count() + odd.count()
        assert run(odd, labels.limit(0)).where("score IS NULL").count() == 0


def test_quality_separates_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), lab).where("held_out").join(lab, "doc_id").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9


def test_language_model_against_brute_force(docs, odd):
    got = lm.language_model_scores(docs).toPandas().set_index("doc_id")
    seq = {i: split(t) + [None] for i, t in texts(docs).items()}
    c, pair, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in seq.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
            for a, b in zip([0, *w[:-1]], w, strict=True):
                pair[a, b] += 1
                before[a] += 1
    n, v = sum(c.values()), len(c)
    q, left = {}, collections.defaultdict(lambda: 1.0)
    for (a, b), k in pair.items():
        if k >= 2:
            q[a, b] = 10 ** (-8 / 254 * min(254, max(0, math.ceil(-math.log10((k - 0.75) / before[a]) * 254 / 8 - 1e-9))))
            left[a] -= q[a, b]
    for i, w in seq.items():
        r = got.loc[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(q.get((a, x), 0) + max(left[a], 1e-6) * (c[x] + 1) / (n + v + 1)) for a, x in zip([0, *w[:-1]], w, strict=True)), rel=1e-4)
    assert lm.language_model_scores(odd).count() == odd.count()
    assert lm.language_model_scores(odd.limit(0)).count() == 0


def test_language_model_query_keeps_pairs_seen_once(spark, sf_dir, docs):
    from foliowash.llm.queries import QUERIES

    got = QUERIES["op4_lm_scoring"](spark, sf_dir).toPandas().set_index("doc_id")["score"]
    seq = {i: split(t) + [None] for i, t in texts(docs).items()}
    c, pair, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in seq.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
            pair.update(zip([0, *w[:-1]], w, strict=True))
            before.update([0, *w[:-1]])
    n, v = sum(c.values()), len(c)
    q, left = {}, collections.defaultdict(lambda: 1.0)
    for (a, b), k in pair.items():
        q[a, b] = 10 ** (-8 / 254 * min(254, max(0, math.ceil(-math.log10((k - 0.75) / before[a]) * 254 / 8 - 1e-9))))
        left[a] -= q[a, b]
    assert any(k == 1 for k in pair.values())
    for i, w in seq.items():
        want = sum(math.log10(q.get((a, x), 0) + max(left[a], 1e-6) * (c[x] + 1) / (n + v + 1)) for a, x in zip([0, *w[:-1]], w, strict=True))
        assert got[i] == pytest.approx(want, rel=1e-4)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[100:160] = x[100] + 0.02 * rng.normal(size=(60, 16))
    x[200:210] = x[200]
    rows = [(k, [float(v) for v in r], k % 3 if k >= 300 else 0) for k, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [1.0, None] + [1.0] * 14, 0), (904, rows[100][1], None), (905, [1.0], 0), (100, rows[100][1], 0), (None, rows[1][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), x


def test_neighbours(vectors):
    df, x = vectors
    info = {}
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, info=info).toPandas()
    ids = np.arange(900)
    hits = total = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        hits, total = hits + len(set(want) & set(mine["vec_id"])), total + 10
    assert hits / total >= 0.9 and info["recall"] >= 0.9
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_embedding_dedup(vectors):
    df, x = vectors
    got = hnsw.near_duplicates(df, shard_rows=100).toPandas()
    assert len(got) == df.count()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k % 3 if k >= 300 else 0 for k in range(900)])
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    link[np.arange(900), np.arange(900)] = False
    low = np.arange(900)
    while True:
        new = np.minimum(low, np.where(link, low[None], 10**6).min(axis=1))
        if (new == low).all():
            break
        low = new
    one = got.dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id")
    extra = link[100].astype(int) + (np.arange(900) == 100)  # vector 100 is there twice
    for k in range(900):
        assert one.loc[k, "n_links"] == link[k].sum() + extra[k], k
        assert one.loc[k, "component_id"] == low[k]
    assert (one.loc[900:905, "n_links"] == 0).all() and one.loc[900:905, "kept"].all()
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir, odd):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, sf_dir)
        assert after.columns == docs.columns, name
        assert {f.name: f.dataType for f in after.schema} == {f.name: f.dataType for f in docs.schema}
        now = p.write_stage(after, name)
    packed = p.STAGES[-1][1](spark, now, sf_dir).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert packed[packed["piece"] == 0].shape[0] == now.count()
    for name, stage in p.STAGES:
        stage(spark, odd, sf_dir).count()
        stage(spark, odd.limit(0), sf_dir).count()


#: Names that operators use inside, and odd ones.
CLASH = ["size", "copies", "target", "source_size", "taken", "_e", "_c1", "_again", "_s", "_p", "_weight", "n", "n_lines", "n_removed", "_gone", "gone", "kept", "kept_id", "_kept_id", "_times", "times", "row", "input", "id", "part", "places", "parts", "component", "node", "shard", "fill", "train", "block", "length", "score", "label", "at", "keys", "a.b"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, t, "en", "ab"[k % 2], 0, *[f"{c}{k}" for c in CLASH]) for k, t in enumerate(ODD)]
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    fields = [("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()), ("n_chars", LongType())]
    return spark.createDataFrame(rows, StructType([StructField(n, t) for n, t in fields + [(c, StringType()) for c in CLASH]]))


def test_clashing_columns_are_kept(clashing, labels, spark, sf_dir):
    import corpus_pipeline as p

    for _, stage in p.STAGES[1:-1]:
        out = stage(spark, clashing, sf_dir)
        assert out.columns == clashing.columns
        for r in out.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASH)
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    n = clashing.count()
    assert p.STAGES[-1][1](spark, clashing, sf_dir).count() >= n
    for run in (lambda d: toxicity.toxicity(d, labels), lambda d: quality.quality(d, labels), packing.pack_documents, lm.language_model_scores, simhash.near_duplicates, lambda d: repair.read(repair.write(d)), linededup.dedup_lines, mixing.mix):
        assert run(clashing).count() >= n


def test_keep_one_with_repeated_ids(spark, odd):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], odd.schema)
    left = lambda rows: sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(make(rows)).collect())
    assert left([(3, a), (3, b), (5, c)]) == [(3, a), (3, b), (5, c)]
    assert left([(1, b), (3, a), (3, b)]) == [(1, b), (3, a)]
    assert left([(2, a)] * 5 + [(4, a), (None, a)][:1]) == [(2, a)]


def test_line_dedup_with_repeated_ids(spark, odd):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(1, f"{a}\n{b}"), (1, f"{b}\nother words in this line"), (1, f"{a}\n{b}"), (None, a), (2, a), (1 << 40, a)]
    out = linededup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], odd.schema)).collect()
    of = collections.defaultdict(list)
    for r in out:
        of[r["doc_id"]].append(r["text"])
    assert of[None] == [a] and of[2] == [""] and of[1 << 40] == [""] and len(of[1]) == 3
    lines = [x for t in of[1] for x in t.split("\n") if x]
    assert lines.count("other words in this line") == 1 and lines.count(a) == 2 and lines.count(b) in (1, 2)


def test_unequal_weights(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 1.2).otherwise(0.4).alias("size"))
    m = mixing.mix(rows, weights=(1,), factor=0.5, weight_col="size").toPandas()
    even = m["doc_id"] % 2 == 0
    assert abs(m["taken"].sum() - 20_000) <= 10 and set(m["copies"]) == {0, 1}
    assert 2.4 < m[even]["copies"].mean() / m[~even]["copies"].mean() < 3.6
    assert mixing.mix_rows(rows, weights=(1,), factor=0.5, weight_col="size").count() == m["copies"].sum()


def test_pieces_equal_the_library(docs, odd):
    e = encoder(default_vocabulary()).library
    for df in (docs, odd):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = e.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            want.update((r["doc_id"], k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())) for k in range(0, len(ids), 512))
        assert collections.Counter(tuple(r) for r in packing.pieces(df, capacity=512).collect()) == want


def test_long_texts_cross_slices(spark, odd):
    rng = np.random.default_rng(8)
    w = [f"w{k}" for k in rng.integers(0, 5000, 1_000_000)]  # over 5 MB
    long = " ".join(w)
    df = spark.createDataFrame([(0, long, "en", "s", 0), (1, "short one", "en", "s", 0), (2, long + " x", "en", "s", 0)], odd.schema)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    fp = int(np.packbits((2 * bits > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])
    assert simhash.fingerprints(df).where("doc_id = 0").first()["fp"] % 2**64 == fp
    n = {r["doc_id"]: r["n_tokens"] for r in repair.read(repair.write(df)).collect()}
    p = {r["doc_id"]: r["n"] for r in packing.pieces(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert n == p and n[0] > 2_000_000 and n[2] > n[0]
    assert lm.language_model_scores(df).where("doc_id = 0").first()["n_tokens"] == 1_000_001
    assert mixing.mix(df).where("doc_id = 2").first()["size"] == 1_000_001


def test_document_by_id(docs):
    e = encoder(default_vocabulary()).library
    table = repair.write(docs, block_ids=20_000, shards=3)
    for r in docs.orderBy(F.desc("doc_id")).limit(5).collect():
        got = repair.document(table, r["doc_id"])
        assert [g.tolist() for g in got] == [e.encode(r["text"], add_special_tokens=False).ids + [1]]
    assert repair.document(table, -5) == []


def test_trie_answers_from_its_file(tmp_path):
    rng = np.random.default_rng(9)
    words_ = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    counts = rng.integers(50, 100, len(words_))
    keys = np.unique((rng.integers(0, len(words_) - 5, 4000).astype(np.uint64) << np.uint64(40)) | rng.integers(0, 1 << 40, 4000).astype(np.uint64))
    made = lm.Trie.build(words_, counts, keys, rng.integers(1, 9, len(keys)), 2)
    made.save(str(tmp_path / "trie"))
    codes, t = made.codes.copy(), lm.Trie.load(str(tmp_path / "trie"))
    kept = t.successors.values(np.arange(t.successors.n))
    assert np.isin(kept, keys).all() and (t.contexts.values(np.arange(len(words_))) == words_).all()
    assert (t.rank(words_) == np.arange(len(words_))).all() and (t.counts == counts).all()
    asked = np.concatenate([keys, keys + np.uint64(1)])
    got = t.find((asked >> np.uint64(40)).astype(np.int64), asked & np.uint64((1 << 40) - 1))
    where = dict(zip(kept.tolist(), codes.tolist(), strict=True))
    assert got.tolist() == [where.get(k, 255) for k in asked.tolist()]


def test_toxicity_likelihoods_by_dictionaries(spark):
    """The ratios that the model looks up, recomputed with dictionaries from the class-conditional counts."""
    rng = np.random.default_rng(10)
    rows = []
    for k in range(300):
        t = ["the", "cat", "sat", "on", "a", "mat", "and", "ran"]
        toxic = k % 3 == 0
        text = [t[i] for i in rng.integers(0, 8, 30)] + (["you", "vile", "fool"] if toxic else ["you", "kind", "friend"])
        rows.append((k, " ".join(text), int(toxic)))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    counts = toxicity.count_expressions(docs_.select(F.col("toxic").alias("label"), "text"))
    model = toxicity.fit_models(counts, 300, least_share=0.0)
    one, two = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for _, text, y in rows:
        w = text.split()
        for x in set(w):
            one[x][y] += 1
        for x in set(zip(w, w[1:], strict=False)):
            two[x][y] += 1
    after = collections.Counter(b for (_, b), v in two.items() if v[0])

    def discount(table, c):
        n1, n2 = (sum(v[c] == k for v in table.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 else 0.5

    kept = [x for x, v in one.items() if sum(v) >= 5]
    base = {x: 0.95 * after[x] / sum(after.values()) + 0.05 / (len(one) + 1) for x in kept}
    p, rest = [{}, {}], [0, 0]
    for c in (0, 1):
        d, total = discount(one, c), sum(v[c] for v in one.values())
        high = {x: max(one[x][c] - d, 0) / total for x in kept}
        rest[c] = max(1e-9, 1 - sum(high.values()))
        p[c] = {x: high[x] + rest[c] * base[x] for x in kept}
    hashes = {x: words(pa.array([x])).hashes()[0] for x in one}
    for x in kept:
        assert model.word_ratio[np.searchsorted(model.word, hashes[x])] == pytest.approx(math.log(p[1][x] / p[0][x]))
    common = [x for x, v in two.items() if sum(v) >= 5]
    free, high = [{}, {}], [{}, {}]
    for c in (0, 1):
        d = discount(two, c)
        sums = collections.Counter()
        for (a, _), v in two.items():
            sums[a] += v[c]
        for a, b in common:
            high[c][a, b] = max(two[a, b][c] - d, 0) / max(1, sums[a])
            free[c][a] = free[c].get(a, 1.0) - high[c][a, b]
    for a, b in common:
        ratio = [high[c][a, b] + max(1e-9, free[c][a]) * p[c][b] for c in (0, 1)]
        at = np.searchsorted(model.pair, toxicity.pair_hash(np.array([hashes[a]]), np.array([hashes[b]]))[0])
        assert model.pair_ratio[at] == pytest.approx(math.log(ratio[1] / ratio[0]))


def test_toxicity_finds_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), lab).where("held_out").join(lab, "doc_id").toPandas()
    assert got[got["toxic"] == 1]["predicted"].mean() >= 0.7 and got[got["toxic"] == 0]["predicted"].mean() <= 0.02


def test_neighbours_keep_order_and_scores(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(200, 8)), 1)
    x[50:60] = x[40]  # ties
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=500, recall=1.0).toPandas()
    for q, mine in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(200), -s)) if j != q]
        mine = mine.sort_values("rank")
        assert mine["vec_id"].tolist() == want and mine["score"].to_numpy() == pytest.approx(s[want], abs=1e-12)


def test_embedding_dedup_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + 0.01 * rng.normal(size=(200, 16))
    df = spark.createDataFrame([(k, [float(v) for v in r], 1) for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 50)
    got = hnsw.near_duplicates(df, shard_rows=60).toPandas().set_index("vec_id")
    assert all(got.loc[k, "n_links"] == 1 and got.loc[k, "component_id"] == k % 200 for k in range(400))


def test_line_dedup_makes_pairs_under_one_key(spark, odd, monkeypatch):
    # variants that match nothing they are first compared with, and share many keys with all others
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(40)]
    lines = [" ".join([w for w in base if rng.random() > 0.12] + [f"u{k}x{j}" for j in range(3)]) for k in range(150)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(lines)], odd.schema)
    joined, write = [], linededup.write_stage

    def rows_of(node):
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(node.nodeName())
        below = [getattr(node, inner)()] if inner else [node.children().apply(k) for k in range(node.children().size())]
        here = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
        return here + [n for b in below for n in rows_of(b)]

    def spy(table, name):
        if name == "far_pairs":
            far = len(table.collect())
            joined.append((far, max(rows_of(table._jdf.queryExecution().executedPlan()))))
        return write(table, name)

    monkeypatch.setattr(linededup, "write_stage", spy)
    assert {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(df).collect()} == brute_lines(df)
    [(far, made)] = joined
    assert far > 100 and made <= 1.5 * far


def test_near_dedup_pairs_fingerprints(spark, odd, monkeypatch):
    base = [f"w{k}" for k in range(400)]
    rows = [base, [*base[:-1], "end"], [f"o{k}" for k in range(200)], ["start", *base], []]
    df = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(rows)], odd.schema)
    made, pairs = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: made.append(pairs(*a)) or made[-1])
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [0, 2, 4]
    assert len(made) == 1  # the trie join has its part

    docs = df.where("doc_id <> 4").select("doc_id", "text", F.xxhash64("text").alias("row"))
    found = simhash.fingerprint_pairs(docs.withColumn("id", F.col("doc_id") + 10), docs, 5, 2).collect()
    fp = dict(zip(range(5), simhash.fingerprints_of(pa.array([" ".join(t) for t in rows]), 5).tolist(), strict=True))
    want = {frozenset((i + 10, j + 10)) for i in range(4) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2}
    low = lambda ps: {frozenset(p) for p in ps}
    assert want and low((r["a"], r["b"]) for r in found) <= want and {x for p in low((r["a"], r["b"]) for r in found) for x in p} == {x for p in want for x in p}


def test_line_dedup_marks_keys_without_a_join(spark, odd, monkeypatch):
    """Keys of many classes get their class's bits without a join; rows that no later step uses are not written."""
    often = [f"f{k}" for k in range(160)]
    sizes = {g: (0, 10, 30) for g in range(10)} | {10: (0, 10, 30, 60, 100, 160)}
    texts_of = [" ".join([*(f"g{g}x{j}" for j in range(4)), *often[:n]]) for g, ns in sizes.items() for n in ns]
    rows = list(enumerate([*texts_of, " ".join(often * 50 + [f"z{k}" for k in range(100)])]))
    plans, tables = {}, {}
    write = linededup.write_stage

    def seen(df, name, **settings):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        tables[name] = write(df, name, **settings)
        if name == "met":
            tables[name + " rows"] = tables[name].collect()
        return tables[name]

    monkeypatch.setattr(linededup, "write_stage", seen)
    got = linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got == []
    assert "Join" not in plans["marked"]
    assert any(r.times > 4 for r in tables["met rows"]) and all(r.times > 4 or r.looks for r in tables["met rows"])


def test_line_dedup_sorts_no_key_of_one_class(spark, odd, monkeypatch):
    """Keys are counted by an aggregate, not by a window over all of them; lines are compared without splitting them twice."""
    rng = np.random.default_rng(14)
    lines = []
    for g, size in enumerate([1, 2, 2, 2, 3, 3, 4, 5, 6, 9]):
        base = [f"g{g}w{k}" for k in range(24)]
        lines += [" ".join(w if rng.random() > 0.05 else f"n{len(lines)}x{j}" for j, w in enumerate(base)) for _ in range(size)]
    lines += [lines[k] for k in (1, 12, 12, 12, 30)]  # copies: their class is looked at by later ones
    rows = [(k, lines[i], "en", "s", 0) for k, i in enumerate(rng.permutation(len(lines)))]
    plans, write = {}, linededup.write_stage

    def seen(df, name, **settings):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, **settings)

    monkeypatch.setattr(linededup, "write_stage", seen)
    for more in ([], [(0, "another text of this id", "en", "s", 0)]):  # places of one number, and of three
        df = spark.createDataFrame(rows + more, odd.schema)
        assert {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(df).collect()} == brute_lines(df)
        windows = [x for x in plans["met"].splitlines() if "Window [" in x]
        assert windows and not any("count(1)" in x for x in windows) and "Aggregate [key" in plans["met"]
        assert not any("Filter" in x and "split(" in x for x in plans["matched"].splitlines())


def test_line_dedup_does_each_step_once(spark, odd, monkeypatch):
    """Words are counted as written, copies meet before the shuffle, words of pairs are compared in one pass, and
    no function is called for each place that a row looks at."""
    rng = np.random.default_rng(21)
    lines = []
    for g in range(12):
        base = [f"Ég{g}W{k}" if k % 3 else f"Often{k}" for k in range(20)]
        lines += [" ".join((w.upper() if rng.random() < 0.3 else w) if rng.random() > 0.06 else f"N{len(lines)}x{j}" for j, w in enumerate(base)) for _ in range(g % 7 + 1)]
    lines += [lines[3].upper(), lines[9].lower(), lines[20]]
    rows = [(k, f"{lines[i]}\n\t{lines[-i - 1]} \r", "en", "s", 0) for k, i in enumerate(rng.permutation(len(lines)))]
    plans, write = collections.defaultdict(list), linededup.write_stage

    def seen(df, name, **settings):
        plans[name].append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name, **settings)

    monkeypatch.setattr(linededup, "write_stage", seen)
    for more in ([], [(0, "another text of this id", "en", "s", 0)]):  # places of one number, and of three
        plans.clear()
        df = spark.createDataFrame(rows + more, odd.schema)
        gone = brute_lines(df)
        assert {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(df).collect()} == gone and len(rows) < len(gone) < 2 * len(rows)
        assert "split(" in plans["array"][0] and "lower(" not in plans["array"][0]
        assert "RepartitionByExpression" not in plans["classes"][0]
        assert all(p.count("array_union(") == 1 and "array_intersect(" not in p for p in plans["matched"])
        assert "lambda" not in plans["met"][0]


def test_pack_sends_texts_in_small_batches(spark, monkeypatch):
    """A worker gets a few MB of text at once, whatever the number of rows; the session's settings stay."""
    docs = spark.createDataFrame([(k, "some words " * 2000) for k in range(1500)], "doc_id long, text string").coalesce(1).cache()
    biggest = []
    write = packing.write_stage

    def seen(df, name, **settings):
        if name == "pieces":
            def count(batches):
                for b in batches:
                    yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

            biggest.append(write(docs.mapInArrow(count, "n long"), "sizes", **settings).agg(F.max("n")).first()[0])
        return write(df, name, **settings)

    monkeypatch.setattr(packing, "write_stage", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    out = packing.pack_documents(docs)
    assert out.select("doc_id").distinct().count() == 1500
    assert 0 < biggest[0] <= 2 * packing.AT_ONCE
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_near_dedup_compares_all_linked_fingerprints(spark, odd, monkeypatch):
    """Similar texts are found by their fingerprints if those connect each of them through unlike ones only."""
    rng = np.random.default_rng(15)
    rows = []
    for g in range(12):  # a repeated phrase makes the fingerprints, tails make the sets
        tail = [f"g{g}t{k}" for k in range(40)]
        rows += [[f"p{k}" for k in range(7)] * 12 + t for t in (tail, tail[:-1])]
    rows = [" ".join(rows[k]) for k in rng.permutation(len(rows))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    fp = simhash.fingerprints_of(pa.array(rows), 5).tolist()
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert 8 <= len(near) <= 12 and {fp[a] == fp[b] for a, b in near} == {True, False}
    signatures = simhash.minhash.signatures
    monkeypatch.setattr(simhash.minhash, "signatures", lambda *a: signatures(*a).withColumn("bands", F.array().cast("array<long>")))
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(rows)], odd.schema)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(range(len(rows))) - {max(p) for p in near}


def test_trie_join_of_labels():
    rng = np.random.default_rng(16)
    base = np.repeat(rng.integers(0, 2**63, 20, dtype=np.uint64), 40)
    v = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)))
    for labels in (rng.integers(0, 3, len(v)), (v >> np.uint64(40)).astype(np.int64) % 5, np.zeros(len(v), np.int64), -1 - np.arange(len(v))):
        i, j = simhash.trie_join(v, 2, labels=labels)
        want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= 2 and labels[a] != labels[b]}
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_encoder_keeps_letters_and_marks_apart():
    """Chunks that differ in case or in the marks after them share their letters; ids are the library's."""
    enc = tokens.Encoder(default_vocabulary())
    enc.encode(pa.array(["Chicken chicken. CHICKEN, chicken.,"]))
    assert sorted(enc.known.to_pylist()) == [",", ".", ".,", "chicken"]
    chars = [chr(c) for c in [*range(0x21, 0x300), 0x301, 0x307, 0x30C, 0x323, 0x345, 0x37E, 0x3A3, 0x3C2, 0x590, 0x1100, 0x1161, 0x1E9E, 0x2019, 0x212A, 0x212B, 0xFB01, 0x1F600] if not 0x7F <= c <= 0xA0]
    rows = [x for c in chars for x in (c, f"a{c}", f"{c}.", f"A{c}b,", f"J{c}!?", f"x.{c}")]
    rows += ["it's.", "IT'S!", "don't,", "a1.", "1a.", "<|endoftext|>.", "a<|endoftext|>", "\x01.", "a\x01.", "w" * 3000 + "..", "Éé-éÉ", "İİ.", "a.b.c.", "", " .", "'s.", "s'.", "a`", "`a"]
    got, bounds = tokens.Encoder(default_vocabulary()).encode(pa.array([*rows, None]), None)
    for k, x in enumerate(rows):
        assert got[bounds[k] : bounds[k + 1]].tolist() == enc.library.encode(x, add_special_tokens=False).ids, x
    whole, _ = tokens.Encoder(default_vocabulary()).encode(pa.array([" ".join(rows)]), None)
    assert whole.tolist() == enc.library.encode(" ".join(rows), add_special_tokens=False).ids


def test_near_dedup_takes_all_fingerprints_of_a_set(spark, odd, monkeypatch):
    """Texts of one set of shingles may have different fingerprints; each of them finds similar texts."""
    phrase, bits = [f"p{k}" for k in range(7)], lambda a, b: int(a ^ b).bit_count()
    found = []
    for g in range(60):
        tail = [f"g{g}t{k}" for k in range(60)]
        rows = [" ".join(phrase * n + t) for n, t in ((12, tail), (2, tail), (2, tail[:-1]))]
        x, y, z = simhash.fingerprints_of(pa.array(rows), 5)
        if bits(y, z) <= 2 < min(bits(x, y), bits(x, z)):
            found.append(rows)
    assert len(found) >= 3
    signatures = simhash.minhash.signatures
    monkeypatch.setattr(simhash.minhash, "signatures", lambda *a: signatures(*a).withColumn("bands", F.array().cast("array<long>")))
    df = spark.createDataFrame([(3 * k + i, t, "en", "s", 0) for k, rows in enumerate(found[:3]) for i, t in enumerate(rows)], odd.schema)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [0, 3, 6]
