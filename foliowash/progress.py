"""Progress events and the package's logger."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from typing import NamedTuple


class Event(NamedTuple):
    stage: str
    page: int = 0
    pages: int = 1
    message: str = ""

    def __str__(self) -> str:
        place = f"[{self.page + 1}/{self.pages}] " if self.pages > 1 else ""
        return f"{place}{self.stage}: {self.message}"


class Progress:
    """Tells its listeners, in order, of each event; those that are None are left out."""

    def __init__(self, *listeners: Callable[[Event], None] | None):
        self.listeners = [f for f in listeners if f]

    def __call__(self, stage: str, **about) -> None:
        for listen in self.listeners:
            listen(Event(stage, **about))


def logger(name: str = "") -> logging.Logger:
    """The package's logger or a child; its level comes from FOLIOWASH_LOG (WARNING if unset)."""
    top = logging.getLogger("foliowash")
    if not top.handlers:
        top.addHandler(logging.StreamHandler())
        top.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        top.setLevel(os.environ.get("FOLIOWASH_LOG", "WARNING").upper())
    return top.getChild(name) if name else top
