import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from foliowash.kernels import fill, image, masks, page

MASKS = arrays(np.uint8, st.tuples(st.integers(3, 24), st.integers(3, 24)), elements=st.sampled_from([0, 255]))


def flood(mask):
    """Sizes of 8-connected components by a plain search."""
    left, sizes = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        sizes.append(n)
    return sorted(sizes)


@settings(max_examples=40, deadline=None)
@given(MASKS)
def test_components(mask):
    label, area = image.components(mask)
    assert sorted(area[1:].tolist()) == flood(mask)
    assert ((label > 0) == (mask > 0)).all()


@settings(max_examples=40, deadline=None)
@given(MASKS, st.sampled_from([2, 3, 5, 7]))
def test_dilation_is_extensive_and_erosion_shrinks(mask, k):
    shape = image.ellipse(k)
    assert (image.dilate(mask, shape) >= mask).all()
    assert (image.erode(mask, shape) <= mask).all()
    assert 0 <= masks.coverage(mask) <= 1


def test_ellipse_of_three_is_a_plus():
    assert image.ellipse(3).astype(int).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]


def test_to_rgb():
    assert image.to_rgb(np.zeros((4, 4), np.uint8)).shape == (4, 4, 3)
    assert image.to_rgb(np.zeros((4, 4, 4), np.uint8)).shape == (4, 4, 3)
    assert image.to_rgb(np.full((1, 1), 2.0))[0, 0, 0] == 255
    with pytest.raises(ValueError):
        image.to_rgb(np.zeros(5))


def test_nms_prefers_high_scores():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [50, 50, 5, 5]])
    assert image.nms(boxes, np.array([0.5, 0.9, 0.1])).tolist() == [1, 2]


def test_tiles_leave_the_rest_alone():
    rng = np.random.default_rng(0)
    for size, tile, overlap in ((64, 32, 8), (128, 64, 16), (20, 64, 16)):
        rgb = rng.integers(0, 256, (size, size * 2, 3), dtype=np.uint8)
        mask = np.zeros(rgb.shape[:2], np.uint8)
        mask[size // 2 :, 5:-5] = 255
        out = fill.tiled(rgb, mask, lambda a, m: np.full_like(a, 255), tile, overlap)
        assert (out[mask == 0] == rgb[mask == 0]).all()
        assert (out[mask > 0] >= 254).all()
    assert (fill.tiled(rgb, np.zeros_like(mask), None) == rgb).all()


def test_paper_fill_takes_the_local_paper():
    rgb = np.full((120, 200, 3), 240, np.uint8)
    rgb[:, 100:] = 230
    mask = np.zeros((120, 200), np.uint8)
    mask[50:60, 20:40] = 255
    rgb[mask > 0] = (200, 30, 30)
    out = fill.paper_fill(rgb, mask)
    assert (out[mask > 0] == 240).all() and (out[mask == 0] == rgb[mask == 0]).all()


def photo(quad, size=(600, 800)):
    rgb = np.full((*size, 3), 110, np.uint8)
    rgb[image.fill_polygon(size, np.array(quad)) > 0] = 245
    return rgb


def iou(a, b, size):
    x, y = image.fill_polygon(size, np.array(a)) > 0, image.fill_polygon(size, np.array(b)) > 0
    return (x & y).sum() / (x | y).sum()


def test_page_is_found_and_flattened():
    quad = [(130, 65), (660, 100), (690, 540), (110, 505)]
    out, info = page.crop(photo(quad))
    assert info.cropped and iou(info.quad, quad, (600, 800)) > 0.9
    assert out[20:-20, 20:-20].min() > 200


def test_no_page():
    flat = np.full((300, 400, 3), 128, np.uint8)
    assert page.detect(flat)[0] is None
    assert "fills" in page.detect(np.full((300, 400, 3), 245, np.uint8) - np.pad(np.full((4, 4, 3), 100, np.uint8), ((10, 286), (10, 386), (0, 0))))[1]
    with pytest.raises(RuntimeError):
        page.crop(flat, fallback="raise")


def test_splits_stay_inside_their_box():
    grey = np.full((30, 200), 255, np.uint8)
    grey[8:20, 5:80] = 0
    grey[8:20, 120:190] = 0
    parts = masks.split_at_gaps(grey, (0, 0, 200, 30))
    assert len(parts) == 2 and all(x >= 0 and x + w <= 200 for x, _, w, _ in parts)
    assert masks.split_uncertain(grey, (0, 0, 10, 5)) == []
    assert len(masks.split_uncertain(grey, (0, 0, 200, 30))) == 2
