"""Spark schemas of pages, boxes and results."""

from __future__ import annotations

BOX = "struct<x:int,y:int,w:int,h:int,score:double,label:string>"
PAGES = "page_id long, origin string, fmt string, height int, width int, n_channels int, data binary"
CLEANED = f"page_id long, origin string, status string, height int, width int, data binary, bbox_count int, mask_coverage double, elapsed_ms double, warnings array<string>, page_cropped boolean, page_deskew_deg double, mask binary, handwriting array<{BOX}>"
