"""Cleaning pages: crop, find text and handwriting, decide box by box, build the mask, repaint.

``clean`` is one map over pages without a shuffle: a page's boxes never leave its row, so a page costs its
own size wherever it is, and the plan scales with the number of partitions. Box tables for analysis come
out of it with ``boxes`` and go through the relational operators of ``operators``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowash.config import Config
from foliowash.kernels import image as K
from foliowash.kernels import masks as M
from foliowash.kernels import page as P
from foliowash.kernels.fill import narrow, paper_fill, tiled
from foliowash.plans import backends
from foliowash.schemas import CLEANED


@dataclass
class Decision:
    mask: np.ndarray
    printed: list[tuple[int, int, int, int]] = field(default_factory=list)
    handwriting: list[tuple[int, int, int, int]] = field(default_factory=list)


def _union_share(box, others) -> float:
    x, y, w, h = box
    canvas = np.zeros((h, w), bool)
    for ox, oy, ow, oh in others:
        canvas[max(0, oy - y) : max(0, oy + oh - y), max(0, ox - x) : max(0, ox + ow - x)] = True
    return float(canvas.mean()) if canvas.size else 0.0


def _read_twice(rgb: np.ndarray, box, reader) -> list[tuple[int, int, int, int, float]]:
    """What the reader finds in a box enlarged to twice its size, in the box's own pixels."""
    x, y, w, h = box
    found = reader(K.resize(rgb[y : y + h, x : x + w], 2 * h, 2 * w))
    return [(int(a) // 2, int(b) // 2, min(w, -(-int(a + c) // 2)) - int(a) // 2, min(h, -(-int(b + d) // 2)) - int(b) // 2, s) for a, b, c, d, _, s in found]


def decide(rgb: np.ndarray, cfg: Config, reader, detector=None, classifier=None) -> Decision:
    """Which boxes are print, which handwriting, and the mask of ink outside print."""
    if rgb.dtype != np.uint8 or rgb.ndim != 3 or rgb.shape[2] != 3:
        raise ValueError("needs a uint8 RGB page")
    h, w = rgb.shape[:2]
    grey = K.luma(rgb)
    boxes = [(x, y, bw, bh) for x, y, bw, bh, _, score in (reader(rgb) if reader else []) if score >= cfg.ocr_min_confidence]
    if cfg.ocr_split_lines_at_gaps:
        boxes = [part for b in boxes for part in M.split_at_gaps(grey, b)]
    boxes = [(max(0, x), max(0, y), min(w, x + bw) - max(0, x), min(h, y + bh) - max(0, y)) for x, y, bw, bh in boxes]
    found = [tuple(map(int, b[:4])) for b in detector(rgb)] if detector and cfg.ocr_use_hw_classifier else []
    printed, handwriting, open_ = [], [], []
    for b in boxes:
        if b[2] <= 0 or b[3] <= 0:
            continue
        # covered boxes are settled before the classifier sees any
        (handwriting if found and _union_share(b, found) >= cfg.ocr_hw_overlap else open_).append(b)
    if classifier and cfg.ocr_use_probability:
        cut = lambda bs: [rgb[y : y + bh, x : x + bw] for x, y, bw, bh in bs]
        parts: list[tuple[int, tuple]] = []
        doubtful = []
        for b, p in zip(open_, classifier(cut(open_)), strict=True):
            if p >= cfg.ocr_uncertain_high or (not cfg.ocr_split_uncertain and p >= cfg.ocr_prob_threshold):
                handwriting.append(b)
            elif p <= cfg.ocr_uncertain_low or not cfg.ocr_split_uncertain:
                printed.append(b)
            else:
                pieces = M.split_uncertain(grey, b, (lambda _, b=b: _read_twice(rgb, b, reader)) if reader else None)
                if len(pieces) < 2:
                    (handwriting if p >= cfg.ocr_prob_threshold else printed).append(b)
                else:
                    doubtful += pieces
        parts = list(zip(doubtful, classifier(cut(doubtful)), strict=True)) if doubtful else []
        for b, p in parts:
            (handwriting if p >= cfg.ocr_prob_threshold else printed).append(b)
    else:
        printed += open_
    grow = 5 if cfg.dilate_px is None else cfg.dilate_px
    color = M.finish(M.color_layer(rgb), cfg.closing_px, cfg.min_box_area, 5, protect=rgb) if cfg.ocr_combine_color else np.zeros((h, w), np.uint8)
    if not printed:
        return Decision(color, [], handwriting + found)
    polys = [np.array([[x, y], [x + bw, y], [x + bw, y + bh], [x, y + bh]]) for x, y, bw, bh in printed]
    left = np.where(M.glyphs(rgb, polys, cfg.ocr_printed_pad_px, cfg.ocr_printed_dilate_px) > 0, 0, K.ink(grey)).astype(np.uint8)
    return Decision(M.finish(color | left, cfg.closing_px, cfg.min_box_area, grow), printed, handwriting + found)


def clean_page(rgb: np.ndarray, cfg: Config, reader=None, detector=None, classifier=None, skew=None):
    """(cleaned page, decision, page info, warnings)."""
    warnings: list[str] = []
    info = P.PageInfo()
    if cfg.crops_page:
        rgb, info = P.crop(rgb, cfg.page_crop_min_area_ratio, cfg.page_crop_deskew_max_deg, skew)
        if info.warning:
            warnings.append(f"page crop: {info.warning}")
    made = decide(rgb, cfg, reader, detector, classifier)
    if not made.mask.any():
        return rgb, made, info, [*warnings, "nothing to remove: output equals input"]
    if cfg.inpainter == "paper":
        mask = narrow(made.mask, made.handwriting) if made.handwriting else made.mask
        return paper_fill(rgb, mask), Decision(mask, made.printed, made.handwriting), info, warnings
    return tiled(rgb, made.mask, backends.get(cfg.inpainter), cfg.tile_size, cfg.tile_overlap), made, info, warnings


def clean(pages: DataFrame, cfg: Config | None = None, reader="stroke_reader", detector="color_detector", classifier=None, strict: bool = False) -> DataFrame:
    """One row of ``CLEANED`` for each page of schema ``PAGES``.

    A page that can't be cleaned (too large, damaged) keeps its row with a status and a warning, unless
    ``strict``. Backends are names of the registry or callables.
    """
    cfg = cfg or Config()

    def run(batches):
        tools = [backends.get(b) for b in (reader, detector, classifier)]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                began = time.perf_counter()
                row = {"page_id": r.page_id, "origin": r.origin, "status": "ok", "height": None, "width": None, "data": None, "bbox_count": 0, "mask_coverage": 0.0, "warnings": [], "page_cropped": False, "page_deskew_deg": 0.0, "mask": None, "handwriting": []}
                try:
                    if r.data is None or r.height is None or r.height * r.width * r.n_channels != len(r.data):
                        raise ValueError("no pixels, or not as many as the size says")
                    if r.height * r.width / 1e6 > cfg.max_image_megapixels:
                        raise ValueError(f"over {cfg.max_image_megapixels} megapixels")
                    rgb = K.to_rgb(np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.n_channels)))
                    out, made, info, warnings = clean_page(rgb, cfg, *tools)
                    row |= {"height": out.shape[0], "width": out.shape[1], "data": out.tobytes(), "bbox_count": len(made.printed), "mask_coverage": M.coverage(made.mask), "warnings": warnings, "page_cropped": info.cropped, "page_deskew_deg": info.deskew_deg, "mask": made.mask.tobytes()}
                    row["handwriting"] = [{"x": b[0], "y": b[1], "w": b[2], "h": b[3], "score": 1.0, "label": "handwriting"} for b in made.handwriting]
                except ValueError as e:
                    if strict:
                        raise
                    row |= {"status": "failed", "warnings": [str(e)]}
                row["elapsed_ms"] = (time.perf_counter() - began) * 1000
                rows.append(row)
            out = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in CLEANED.split(", ")])
            yield out.astype({"height": "Int32", "width": "Int32"})

    return pages.select("page_id", "origin", "height", "width", "n_channels", "data").mapInPandas(run, CLEANED)


def boxes(cleaned: DataFrame) -> DataFrame:
    """Handwriting boxes as a table for the relational operators: page, id, x, y, w, h."""
    return cleaned.select(F.col("page_id").alias("page"), F.posexplode("handwriting").alias("id", "b")).select("page", "id", "b.x", "b.y", "b.w", "b.h")
