"""Repainting: locally sampled paper colour, or a painter called tile by tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from foliowash.kernels import image as K
from foliowash.kernels.masks import paper_color


def narrow(mask: np.ndarray, boxes, reach: int = 35) -> np.ndarray:
    """The mask near handwriting boxes alone; without boxes nothing is left."""
    if not len(boxes):
        return np.zeros_like(mask)
    return np.where(K.dilate(K.fill_boxes(mask.shape, boxes), K.ellipse(reach)) > 0, mask, 0).astype(np.uint8)


def paper_fill(rgb: np.ndarray, mask: np.ndarray, below: int = 25, above: int = 10, size: int = 51, least: int = 30) -> np.ndarray:
    """Masked pixels take the mean of nearby paper, or the page's paper colour where too little is near."""
    if rgb.dtype != np.uint8 or rgb.ndim != 3 or mask.dtype != np.uint8 or mask.shape != rgb.shape[:2]:
        raise ValueError("needs a uint8 RGB page and a uint8 mask of its size")
    if not mask.any():
        return rgb.copy()
    paper = np.array(paper_color(rgb, 50))
    bright = int(paper @ [0.299, 0.587, 0.114])
    grey = K.luma(rgb)
    good = (K.dilate(mask, K.ellipse(17)) == 0) & (grey >= max(120, bright - below)) & (grey <= bright + above)
    out = rgb.copy()
    if not good.any():
        out[mask > 0] = paper
        return out
    n = K.box_sum(good, size)
    for c in range(3):
        mean = K.box_sum(np.where(good, rgb[..., c], 0), size) / np.maximum(n, 1)
        out[..., c] = np.where(mask > 0, np.where(np.round(n) >= least, np.floor(mean + 1e-6), paper[c]), rgb[..., c]).astype(np.uint8)
    return out


def feather(n: int) -> np.ndarray:
    return np.ones(n) if n <= 1 else np.maximum((1 - np.cos(np.linspace(-np.pi, np.pi, n) + np.pi)) / 2, 1e-3)


def tiled(rgb: np.ndarray, mask: np.ndarray, painter: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = 512, overlap: int = 64) -> np.ndarray:
    """Calls ``painter`` on every tile that has masked pixels and blends the tiles; nothing else changes."""
    h, w = mask.shape
    out = rgb.copy()
    if not mask.any():
        return out

    def painted(a, b):
        p = painter(a, b)
        if p.shape != a.shape:
            raise ValueError("the painter changed the tile's size")
        return p

    if h <= tile and w <= tile:
        out[mask > 0] = painted(rgb, mask)[mask > 0]
        return out
    step = max(1, tile - overlap)
    starts = lambda n: sorted({max(0, min(s, n - tile)) for s in range(0, max(1, n - overlap), step)})
    total, weight = np.zeros(rgb.shape), np.zeros((h, w))
    for y in starts(h):
        for x in starts(w):
            y2, x2 = min(h, y + tile), min(w, x + tile)
            if mask[y:y2, x:x2].any():
                f = np.outer(feather(y2 - y), feather(x2 - x))
                total[y:y2, x:x2] += painted(rgb[y:y2, x:x2], mask[y:y2, x:x2]) * f[..., None]
                weight[y:y2, x:x2] += f
    at = (mask > 0) & (weight > 0)
    out[at] = np.clip(np.round(total[at] / weight[at][:, None]), 0, 255).astype(np.uint8)
    return out


class OnnxPainter:
    """A painter around an onnxruntime session: image and mask as 0..1 NCHW, sizes rounded up to eights
    unless the model's are fixed. Untested without a model file."""

    def __init__(self, path: str, providers: list[str] | None = None):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=providers or ["CPUExecutionProvider"])
        names = [i.name for i in self.session.get_inputs()]
        self.image = next((n for n in names if "image" in n or "img" in n), names[0])
        self.mask = next((n for n in names if "mask" in n), names[-1])
        shape = next(i.shape for i in self.session.get_inputs() if i.name == self.image)
        self.fixed = tuple(shape[2:4]) if all(isinstance(v, int) for v in shape[2:4]) else None

    def __call__(self, rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h, w = mask.shape
        if self.fixed:
            a, m = K.resize(rgb, *self.fixed, "area"), K.resize(mask, *self.fixed, "nearest")
        else:
            pad = ((0, -h % 8), (0, -w % 8))
            a, m = np.pad(rgb, (*pad, (0, 0)), mode="symmetric"), np.pad(mask, pad, mode="symmetric")
        feed = {self.image: a.transpose(2, 0, 1)[None].astype(np.float32) / 255, self.mask: (m > 0)[None, None].astype(np.float32)}
        out = self.session.run(None, feed)[0][0].transpose(1, 2, 0)
        out = np.clip(np.round(out * (255 if out.max() <= 1.5 else 1)), 0, 255).astype(np.uint8)
        return K.resize(out, h, w) if self.fixed else out[:h, :w]
