"""Pluggable page backends: restoration and enlargement stages by name, as functions on gray pages.

Neural models aren't part of this engine. A backend is a factory that takes parameters and gives a function page -> page; it is made once a task
by the stage that uses it. The classical ones here stand in for models: background division, and enlargement by repetition.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..operators import raster

Page = np.ndarray
Factory = Callable[..., Callable[[Page], Page]]
REGISTRY: dict[tuple[str, str], Factory] = {}


def register(stage: str, name: str) -> Callable[[Factory], Factory]:
    def keep(f: Factory) -> Factory:
        REGISTRY[stage, name] = f
        return f

    return keep


def available() -> dict[str, list[str]]:
    return {s: sorted(n for t, n in REGISTRY if t == s) for s in sorted({t for t, _ in REGISTRY})}


def create(stage: str, name: str, **parameters) -> Callable[[Page], Page]:
    if (stage, name) not in REGISTRY:
        raise KeyError(f"no backend {name!r} for stage {stage!r}; there are {available().get(stage, [])}")
    return REGISTRY[stage, name](**parameters)


@register("restore", "none")
@register("sr", "none")
def same(**_) -> Callable[[Page], Page]:
    return lambda page: page


@register("restore", "background")
def background(size: int = 7, median: int = 21, **_) -> Callable[[Page], Page]:
    """Divides a page by its background: dilated, then smoothed by a median."""

    def run(page: Page) -> Page:
        back = raster.median(raster.dilate(page, np.ones((size, size), bool)), median).astype(np.float64)
        return np.clip(page / np.maximum(back, 1) * 255, 0, 255).astype(np.uint8)

    return run


@register("sr", "repeat")
def repeat(scale: int = 2, **_) -> Callable[[Page], Page]:
    return lambda page: page.repeat(scale, axis=0).repeat(scale, axis=1)


@register("sr", "cubic")
def cubic(scale: int = 2, **_) -> Callable[[Page], Page]:
    """Four times as large by cubic interpolation, then down to `scale` by Lanczos."""
    from ..operators.pageimage import resize

    def run(page: Page) -> Page:
        h, w = page.shape[:2]
        large = resize(page, 4 * h, 4 * w, "cubic")
        return large if scale == 4 else resize(large, scale * h, scale * w, "lanczos")

    return run


def weights(name: str, folders: list[str]) -> str:
    """Path of a model's file in the first folder that has it."""
    for folder in folders:
        if os.path.isfile(path := os.path.join(folder, name)):
            return path
    raise FileNotFoundError(f"{name} is in none of {folders}")


def enhanced(pages: DataFrame, restore: str = "none", sr: str = "none", **parameters) -> DataFrame:
    """Pages (page, h, w, data) through both stages; names are checked before any page is read, and each task makes its own stages once."""
    for stage, name in (("restore", restore), ("sr", sr)):
        if (stage, name) not in REGISTRY:
            create(stage, name)  # says which there are

    def stages() -> Callable[[Page], Page]:
        first, second = create("restore", restore, **parameters), create("sr", sr, **parameters)
        return lambda page: second(first(page))

    return raster.on_pages(pages, make=stages)
