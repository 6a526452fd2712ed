"""Model backends behind small interfaces, and a registry of them by name.

Models are built once per Python worker. Those here are rule-based stand-ins that need no weights; a real
text reader, handwriting detector, classifier or painter is added with ``register``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np

from foliowash.kernels import image as K
from foliowash.kernels.fill import OnnxPainter, paper_fill


class Reader(Protocol):
    """Text boxes (x, y, w, h, text, score) of a page."""

    def __call__(self, rgb: np.ndarray) -> list[tuple[int, int, int, int, str, float]]: ...


class Detector(Protocol):
    """Handwriting boxes (x, y, w, h, score) of a page."""

    def __call__(self, rgb: np.ndarray) -> list[tuple[int, int, int, int, float]]: ...


class Classifier(Protocol):
    """Probability of handwriting for each crop; 0.0 for an empty one, order kept."""

    def __call__(self, crops: list[np.ndarray]) -> list[float]: ...


def _boxes_of(mask: np.ndarray, join: int) -> list[tuple[int, int, int, int]]:
    label, n = K.components(K.dilate(mask, np.ones((3, 2 * join + 1), bool)))
    out = []
    for k in range(1, len(n)):
        y, x = np.nonzero((label == k) & (mask > 0))
        if len(y):
            out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return out


def stroke_reader(rgb: np.ndarray):
    """Stand-in reader: rows of dark grey ink, much wider than high."""
    c = rgb.astype(int)
    dark = (K.luma(rgb) < 110) & (c.max(axis=2) - c.min(axis=2) <= 40)
    return [(x, y, w, h, "", 0.99) for x, y, w, h in _boxes_of(np.where(dark, 255, 0).astype(np.uint8), 12) if w >= 3 * h and 6 <= h <= 80]


def color_detector(rgb: np.ndarray):
    """Stand-in detector: groups of coloured strokes."""
    c = rgb.astype(int)
    vivid = c.max(axis=2) - c.min(axis=2) >= 60
    return [(x, y, w, h, 0.9) for x, y, w, h in _boxes_of(np.where(vivid, 255, 0).astype(np.uint8), 20) if w * h >= 100]


def spread_classifier(crops):
    """Stand-in classifier: uneven stroke density over columns looks handwritten."""
    out = []
    for crop in crops:
        if not crop.size or crop.min() == crop.max():
            out.append(0.0)
            continue
        grey = K.luma(crop)
        used = (grey <= K.otsu(grey)).mean(axis=0)
        out.append(float(np.clip(used.std() / max(1e-6, used.mean()) - 0.5, 0, 1)))
    return out


_FACTORIES: dict[str, Callable[[], Callable]] = {
    "none": lambda: None, "stroke_reader": lambda: stroke_reader, "color_detector": lambda: color_detector, "spread_classifier": lambda: spread_classifier,
    "paper": lambda: paper_fill,
}
_BUILT: dict[str, Callable] = {}


def register(name: str, factory: Callable[[], Callable]) -> None:
    _FACTORIES[name] = factory
    _BUILT.pop(name, None)


def register_onnx_painter(name: str, path: str, sha256: str | None = None) -> None:
    """A painter from a model file that is already there; its sum is checked if given."""

    def build():
        if sha256:
            with open(path, "rb") as f:
                if hashlib.sha256(f.read()).hexdigest() != sha256:
                    raise ValueError(f"{path} has another sha256")
        return OnnxPainter(path)

    register(name, build)


def get(spec: str | Callable | None):
    """A backend by name (built once a worker), or the callable itself."""
    if spec is None or callable(spec):
        return spec
    if spec not in _FACTORIES:
        raise ValueError(f"unknown backend: {spec}")
    if spec not in _BUILT:
        _BUILT[spec] = _FACTORIES[spec]()
    return _BUILT[spec]
