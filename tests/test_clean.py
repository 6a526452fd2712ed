import numpy as np
import pytest

from foliowash import Config, preset, clean
from foliowash.plans import backends
from foliowash.plans.clean import boxes, decide
from foliowash.sources.pages import encode, from_arrays, read_files, read_images, synthetic_page, write_cleaned


def page():
    rgb = np.full((300, 400, 3), 255, np.uint8)
    rgb[40:52, 30:350:6] = 0
    rgb[45:48, 30:350] = 0
    rgb[180:186, 60:260] = 0
    return rgb


def reader(_):
    return [(30, 38, 320, 16, "text", 0.99)]


def test_ink_outside_print_is_masked():
    made = decide(page(), Config(), reader)
    assert (made.mask[180:186, 60:260] > 0).mean() > 0.8
    assert made.mask[40:52, 30:350].mean() < 30


def test_nothing_accepted_gives_an_empty_mask():
    assert not decide(page(), Config(), lambda _: [(30, 38, 320, 16, "", 0.1)]).mask.any()


def test_a_covered_box_is_handwriting():
    made = decide(page(), Config(), reader, lambda _: [(0, 0, 400, 100, 0.9)])
    assert made.handwriting and not made.printed
    assert decide(page(), Config(), reader, lambda _: [(300, 280, 20, 10, 0.9)]).printed


def test_classifier_bands():
    for p, printed in ((0.9, False), (0.01, True)):
        assert bool(decide(page(), Config(ocr_split_lines_at_gaps=False), reader, None, lambda crops, p=p: [p] * len(crops)).printed) is printed


def test_clean_keeps_every_page(spark):
    pages = from_arrays(spark, [synthetic_page(height=900, width=700), np.full((40, 40, 3), 255, np.uint8)])
    bad = pages.limit(1).selectExpr("99L page_id", "origin", "fmt", "height + 1 height", "width", "n_channels", "data")
    rows = {r["page_id"]: r for r in clean(pages.unionByName(bad), Config(ocr_combine_color=True)).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {0: "ok", 1: "ok", 99: "failed"}
    assert rows[0]["mask_coverage"] > 0 and rows[1]["warnings"]
    before = np.frombuffer(pages.first()["data"], np.uint8)
    after, mask = np.frombuffer(rows[0]["data"], np.uint8), np.frombuffer(rows[0]["mask"], np.uint8)
    assert (before.reshape(-1, 3)[mask == 0] == after.reshape(-1, 3)[mask == 0]).all()
    assert clean(pages, Config(max_image_megapixels=0.001)).where("status = 'failed'").count() == 2


def test_png_round_trip_through_spark(spark, tmp_path):
    rgb = synthetic_page(height=60, width=80)
    (row,) = encode(clean(from_arrays(spark, [rgb]))).collect()
    (tmp_path / "a.png").write_bytes(row["png"])
    (tmp_path / "b.png").write_bytes(b"no image")
    found = {r["height"]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert bytes(found[60]["data"]) == bytes(row["data"]) and found[0]["data"] is None
    assert {r["kind"] for r in read_files(spark, str(tmp_path)).collect()} == {"image"}


def test_sink_and_boxes(spark, tmp_path):
    out = clean(from_arrays(spark, [synthetic_page(height=1300, width=1000)]))
    write_cleaned(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert boxes(out).count() >= 1


def test_stream(spark, tmp_path):
    from foliowash.streaming.clean import start

    from_arrays(spark, [synthetic_page(height=100, width=100)]).write.parquet(str(tmp_path / "in"))
    q = start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_config_and_backends():
    assert preset("photo").crops_page and preset("upload").crops_page and not preset("scan").crops_page
    with pytest.raises(ValueError):
        preset("other")
    with pytest.raises(ValueError):
        backends.get("other")
    assert backends.spread_classifier([np.zeros((0, 0, 3), np.uint8)]) == [0.0]


def test_uncertain_boxes_are_read_again_at_twice_their_size():
    page = np.full((60, 320, 3), 255, np.uint8)
    page[20:40, 10:310:3] = 0
    seen = []

    def reader(rgb):
        seen.append(rgb.shape[:2])
        if len(seen) == 1:
            return [(10, 15, 300, 30, "", 0.99)]
        return [(k * 200, 0, 200, 60, "", 0.9) for k in range(3)]

    made = decide(page, Config(), reader, None, lambda crops: [0.2] * len(crops))
    assert seen == [(60, 320), (60, 600)] and made.printed + made.handwriting == [(10, 15, 100, 30), (110, 15, 100, 30), (210, 15, 100, 30)]
