import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliowash import Config
from foliowash.kernels import crops as C
from foliowash.kernels import image as K
from foliowash.operators import detections as D
from foliowash.operators import evaluate as E
from foliowash.plans import crops as P
from foliowash.progress import Event, Progress, logger
from foliowash.sources.pages import from_arrays, synthetic_page


def _boxed(rgb):
    """Each black rectangle, found by its corners."""
    label, n = K.components(np.where(K.luma(rgb) < 60, 255, 0).astype(np.uint8))
    out = []
    for k in range(1, len(n)):
        y, x = np.nonzero(label == k)
        out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, 0.9))
    return out


def test_tiled_detection_gives_each_box_once_at_its_place():
    page = np.full((500, 700, 3), 255, np.uint8)
    want = {(20, 30, 60, 20), (400, 310, 50, 40), (630, 450, 40, 25)}
    for x, y, w, h in want:
        page[y : y + h, x : x + w] = 0
    assert {b[:4] for b in C.detect_tiled(page, _boxed, 300, 100)} == want
    # only windows see small boxes here, and those of under 100 pixels are not looked at
    seen = []
    C.detect_tiled(page, lambda part: seen.append(part.shape[:2]) or [], 300, 100)
    assert seen[0] == (500, 700) and all(min(s) >= 100 for s in seen[1:]) and len(seen) == 1 + 2 * 3
    assert C.detect_tiled(page, lambda part: [], 0) == []


def test_corners(spark):
    rows = [(1, 1.9, 2.5, 4.4, 5.0), (2, -1.5, 0.0, -0.6, 9.0), (3, 5.0, 5.0, 4.0, 9.0), (4, None, 0.0, 9.0, 9.0), (5, 0.5, 1.5, 10.0, 10.0)]
    found = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in D.from_corners(found).collect()} == {(1, 1, 2, 2, 2), (5, 0, 1, 9, 8)}
    assert {tuple(r) for r in D.from_corners(found, nearest=True, min_area=9).collect()} == {(2, -2, 0, 1, 9), (5, 0, 2, 10, 8)}
    assert D.from_corners(found.limit(0)).count() == 0


def test_split_parts_cover_their_box(spark):
    boxes = spark.createDataFrame([(1, 3, 4, 101, 20), (2, 0, 0, 15, 15), (3, 7, 1, 9, 40)], "id int, x int, y int, w int, h int")
    parts = D.split_again(boxes, F.lit(True), 3).collect()
    area = {k: sum(r["w"] * r["h"] for r in parts if r["id"] == k) for k in (1, 2, 3)}
    assert area == {1: 2020, 2: 225, 3: 360} and max(r["depth"] for r in parts) == 3
    assert [r["depth"] for r in parts if r["id"] == 2] == [0]


def test_prepare():
    rng = np.random.default_rng(0)
    crop = rng.integers(0, 256, (30, 200, 3)).astype(np.uint8)
    assert C.prepare(crop, "rgb").shape == (3, 96, 96) and C.prepare(crop, "bin1").shape == (1, 96, 96)
    assert set(np.unique(C.prepare(crop, "bin3"))) == {-1.0, 1.0}
    flat = np.full((50, 40, 3), 120, np.uint8)
    assert np.allclose(C.prepare(flat, "rgb")[:, 5, 5], (120 / 255 - np.array(C.MEAN["rgb"])) / np.array(C.STD["rgb"]))
    # ink is 1 and paper -1
    half = np.full((96, 96, 3), 250, np.uint8)
    half[:, :48] = 10
    assert (C.prepare(half)[:, :, :48] == 1).all() and (C.prepare(half)[:, :, 48:] == -1).all()
    # by hand: the mean of pairs, weighted by a triangle of two samples each side
    line = np.arange(0, 160, 20, dtype=np.uint8)[None, :].repeat(8, axis=0)
    assert C.shrink(line, 4)[2, 1] == round((0.25 * 20 + 0.75 * 40 + 0.75 * 60 + 0.25 * 80) / 2)
    with pytest.raises(ValueError):
        C.prepare(crop, "other")


def test_classifier_keeps_places():
    network = lambda batch: np.stack([np.zeros(len(batch)), batch.mean(axis=(1, 2, 3))], axis=1)
    dark = np.zeros((20, 20, 3), np.uint8)
    dark[:, 10:] = 255
    got = C.classifier_of(network, batch=1)([np.zeros((0, 4, 3), np.uint8), dark, dark[:, 10:]])
    assert got[0] == 0.0 and 0.45 < got[1] < 0.55 and len(got) == 3


def test_crops_from_page_to_files(spark, tmp_path):
    pages = from_arrays(spark, [synthetic_page(height=600, width=800)])
    crops = P.extract_crops(pages, classifier="spread_classifier")
    rows = crops.collect()
    assert rows and all(len(r["data"]) == r["w"] * r["h"] * 3 and r["depth"] == 0 and 0 <= r["prob"] <= 1 for r in rows)
    assert P.extract_crops(pages.withColumn("data", F.lit(None).cast("binary"))).count() == 0
    parts = P.split_mixed(crops, F.col("y") == rows[0]["y"]).collect()
    cut = [r for r in parts if r["depth"] == 1]
    assert len(cut) >= 2 and all(r["text"] == "[split d1]" and rows[0]["x"] <= r["x"] and r["x"] + r["w"] <= rows[0]["x"] + rows[0]["w"] for r in cut)
    labelled = crops.withColumn("label", F.when(F.col("y") == rows[0]["y"], "hw").otherwise("printed"))
    P.write_crops(labelled, str(tmp_path / "crops"))
    saved = spark.read.parquet(str(tmp_path / "crops"))
    assert {r["label"]: r["n"] for r in P.saved_counts(saved).collect()} == {r["label"]: r["n"] for r in P.saved_counts(labelled).collect()}
    assert saved.where("label = 'hw'").first()["name"] == f"memory_{rows[0]['x']}_{rows[0]['y']}_d0.png"


def test_features_carry_labels(spark):
    pages = from_arrays(spark, [np.zeros((10, 20, 3), np.uint8)] * 2).withColumn("origin", F.concat(F.lit("/c/"), F.when(F.col("page_id") == 0, "hw").otherwise("printed"), F.lit("/a.png")))
    got = P.labelled_features(pages, "bin1").orderBy("page_id").collect()
    assert [r["label"] for r in got] == [1, 0] and len(got[0]["features"]) == 96 * 96


def test_ranked_results_are_written_best_first(spark, tmp_path):
    scored = spark.createDataFrame([("a", 1, 90), ("a", 0, 10), ("b", 1, 20), ("b", 0, 80), ("b", 1, 85)], "variant string, label int, prob_pct int")
    E.write_ranked(E.holdout(scored, by=("variant",)), str(tmp_path / "ranked"))
    lines = [json.loads(x) for f in sorted((tmp_path / "ranked").glob("*.json")) for x in f.read_text().splitlines()]
    assert [(x["variant"], x["rank"], x["thr"]) for x in lines] == [("a", 1, 15), ("b", 2, 85)]
    assert E.holdout(scored.limit(0), by=("variant",)).count() == 0


def test_variants_and_options(spark):
    assert P.parse_options(["dilate_px=7", "method=adaptive", "empty"]) == {"dilate_px": 7, "method": "adaptive", "empty": ""}
    pages = from_arrays(spark, [synthetic_page(height=120, width=160)])
    out = P.clean_variants(pages, {"d3": Config(dilate_px=3), "d9": Config(dilate_px=9)}).select("tag", "status", "mask_coverage").collect()
    assert {r["tag"]: r["status"] for r in out} == {"d3": "ok", "d9": "ok"}
    with pytest.raises(ValueError):
        P.clean_variants(pages, {})


def test_progress():
    heard = []
    Progress(heard.append, None, lambda e: heard.append(str(e)))("mask", page=1, pages=3, message="done")
    Progress()("mask")
    assert heard == [Event("mask", 1, 3, "done"), "[2/3] mask: done"]
    assert logger("io").name == "foliowash.io" and len(logger().handlers) == 1
