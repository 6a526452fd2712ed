"""What to repaint on a page: colour layers, ink outside printed glyphs, and boxes."""

from __future__ import annotations

import numpy as np

from foliowash.functions.pixels import ANY_COLORED, PROFILES
from foliowash.kernels import image as K

_CHANNEL = {"r": 0, "g": 1, "b": 2}


def _rules(name: str):
    rows = [p for p in PROFILES if name in (p[0], ANY_COLORED)]
    if not rows:
        raise ValueError(f"unknown colour profile: {name}")
    return rows


def paper_color(rgb: np.ndarray, percentile: float = 70) -> tuple[int, int, int]:
    """Median of the pixels brighter than a percentile; white if there are none."""
    grey = rgb.reshape(-1, 3).mean(axis=1)
    bright = rgb.reshape(-1, 3)[grey > np.percentile(grey, percentile)]
    return tuple(int(v) for v in np.median(bright, axis=0)) if len(bright) else (255, 255, 255)


def finish(mask: np.ndarray, closing: int = 3, least: int = 12, grow: int = 5, protect: np.ndarray | None = None) -> np.ndarray:
    """Closes gaps, drops small components, then grows, in this order; spares print if an image is given."""
    if closing > 1:
        mask = K.close(mask, K.ellipse(closing))
    if least > 1:
        mask = K.drop_small(mask, least)
    if grow > 1:
        mask = K.dilate(mask, K.ellipse(grow))
    if protect is not None:
        dark = (K.luma(protect) < 90) & (protect.max(axis=2).astype(int) - protect.min(axis=2) <= 25)
        mask = np.where(dark, 0, mask).astype(np.uint8)
    return mask


def color_layer(rgb: np.ndarray, name: str = ANY_COLORED, edge: int | None = None) -> np.ndarray:
    """Strokes of a colour: sure pixels grown into likely ones."""
    c, out = rgb.astype(np.int16), np.zeros(rgb.shape[:2], np.uint8)
    for _, dominant, rivals, lead, bright in _rules(name):
        top = c[..., _CHANNEL[dominant]]
        gap = np.min([top - c[..., _CHANNEL[v]] for v in rivals], axis=0)
        weak = max(15, min(30, lead // 2)) if edge is None else edge
        out |= K.reconstruct((top >= bright) & (gap >= lead), (top >= max(40, bright // 3)) & (gap >= weak))
    return out


def adaptive_layer(rgb: np.ndarray, name: str, threshold: int = 50) -> np.ndarray:
    """Strokes by how far they lean from the page's own paper colour."""
    if name == ANY_COLORED:
        raise ValueError("the adaptive mask takes one profile")
    (_, dominant, rivals, _, _), c, paper = _rules(name)[0], rgb.astype(np.int16), paper_color(rgb)
    signal = c[..., _CHANNEL[dominant]] - paper[_CHANNEL[dominant]] + np.max([paper[_CHANNEL[v]] - c[..., _CHANNEL[v]] for v in rivals], axis=0)
    return K.reconstruct(signal >= threshold, signal >= max(15, threshold // 2))


def glyphs(rgb: np.ndarray, polys: list[np.ndarray], pad: int = 4, grow: int = 2) -> np.ndarray:
    """Dark strokes within accepted text polygons, each by its own threshold."""
    grey, (h, w) = K.luma(rgb), rgb.shape[:2]
    out = np.zeros((h, w), np.uint8)
    for poly in polys:
        p = np.asarray(poly, float)
        x0, y0 = max(0, int(p[:, 0].min()) - pad), max(0, int(p[:, 1].min()) - pad)
        x1, y1 = min(w, int(np.ceil(p[:, 0].max())) + pad), min(h, int(np.ceil(p[:, 1].max())) + pad)
        if x0 >= x1 or y0 >= y1:
            continue
        part = grey[y0:y1, x0:x1]
        if part.min() == part.max():
            continue
        dark = part <= K.otsu(part)
        area = K.dilate(K.fill_polygon(part.shape, p - [x0, y0]), np.ones((2 * pad + 1, 2 * pad + 1), bool)) > 0
        out[y0:y1, x0:x1] |= np.where(dark & area, 255, 0).astype(np.uint8)
    return K.dilate(out, K.ellipse(grow)) if grow > 1 else out


def split_at_gaps(grey: np.ndarray, box: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """A text box cut where whole columns are empty; itself if fewer than two parts are wide enough."""
    x, y, w, h = box
    part = grey[y : y + h, x : x + w]
    if w < 16 or h < 8 or not part.size or part.min() == part.max():
        return [box]
    used = (part <= K.otsu(part)).any(axis=0)
    edge = np.diff(np.concatenate([[True], used, [True]]).astype(int))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    wide = (ends - starts) >= max(3, round(0.25 * h))
    cuts = [(0, 0), *zip(starts[wide].tolist(), ends[wide].tolist(), strict=True), (w, w)]
    runs = [(a[1], b[0]) for a, b in zip(cuts, cuts[1:], strict=False)]
    runs = [(a, b) for a, b in runs if b - a >= max(12, round(0.10 * w))]
    return [(x + a, y, b - a, h) for a, b in runs] if len(runs) >= 2 else [box]


def split_uncertain(grey: np.ndarray, box: tuple[int, int, int, int], reader=None) -> list[tuple[int, int, int, int]]:
    """Parts of a doubtful box: what a reader finds in it, else at its widest empty gap, else its two halves."""
    x, y, w, h = box
    if w < 16 or h < 8:
        return []
    part = grey[y : y + h, x : x + w]
    if reader is not None:
        found = [(bx, by, bw, bh) for bx, by, bw, bh, s in reader(part) if s >= 0.20 and not (bw >= 0.85 * w and bh >= 0.85 * h) and bw * bh >= 200]
        if len(found) >= 2:
            return [(x + a, y + b, c, d) for a, b, c, d in found]
    if w >= 40 and part.size and part.min() < part.max():
        margin = max(2, w // 20)
        empty = ~(part <= K.otsu(part)).any(axis=0)
        empty[:margin] = empty[w - margin :] = False
        edge = np.diff(np.concatenate([[False], empty, [False]]).astype(int))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s) and (e - s).max() >= max(4, w // 30):
            k = int(np.argmax(e - s))
            a, b = int(s[k]), int(e[k])
            if a * h >= 200 and (w - b) * h >= 200:
                return [(x, y, a, h), (x + b, y, w - b, h)]
    if w >= h:
        return [(x, y, w // 2, h), (x + w // 2, y, w - w // 2, h)] if w >= 16 else []
    return [(x, y, w, h // 2), (x, y + h // 2, w, h - h // 2)] if h >= 16 else []


def box_mask(rgb: np.ndarray, boxes, grow: int | None = None, closing: int = 3) -> np.ndarray:
    """Boxes filled, grown and closed; growth follows the page's height unless given."""
    h, w = rgb.shape[:2]
    if not len(boxes):
        return np.zeros((h, w), np.uint8)
    grow = max(3, min(25, h // 470)) if grow is None else grow
    mask = K.dilate(K.fill_boxes((h, w), boxes), K.ellipse(max(1, grow)))
    return K.close(mask, K.ellipse(closing)) if closing > 0 else mask


def coverage(mask: np.ndarray) -> float:
    return float((mask > 0).mean()) if mask.size else 0.0
