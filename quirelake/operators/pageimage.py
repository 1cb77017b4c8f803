"""Operators on whole colour pages, one binary row a page: masks, features and classes of real scans.

A page is a row (page, h, w, data): data holds the bytes b, g, r of each pixel in row order. All steps of a page run in one Arrow batch function, so a page is read once, nothing is
shuffled and no pixel becomes a row. The pixel-row operators of `classify` and `neighbourhood` are the twins that SQL can check on small pages. Rows with null or short data give null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.pixel import ACHROMATIC, DARK, GRADIENT, INK, MID_HIGH, MID_LOW, SATURATION
from .classify import BLOB
from .components import label_mask
from .raster import dilate, ellipse, erode, opening

#: Share of a page from which on a connected dark or coloured region is a figure, and the area under which a component is a speck (fixed values).
FIGURE, SPECK = 0.004, 24
#: By how much a gray figure is darker than paper, and the least deviation of its grays (fixed values).
DARKER, UNEVEN = 35, 12
BOX3, BOX7 = np.ones((3, 3), bool), np.ones((7, 7), bool)


def decode(data: bytes | None, h: int | None, w: int | None) -> np.ndarray | None:
    """Pixels (h x w x 3) of a page; None where bytes are missing, as for an image that can't be read."""
    if data is None or not h or not w or len(data) < 3 * h * w:
        return None
    return np.frombuffer(data, np.uint8, 3 * h * w).reshape(h, w, 3)


def luma(bgr: np.ndarray) -> np.ndarray:
    return (bgr.astype(np.int32) @ np.array([114, 587, 299], np.int32) // 1000).astype(np.uint8)


def channel_spread(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest channel, and by how much it exceeds the smallest."""
    top = bgr.max(axis=2).astype(np.int32)
    return top, top - bgr.min(axis=2)


def saturation(bgr: np.ndarray) -> np.ndarray:
    top, spread = channel_spread(bgr)
    return 255 * spread // np.maximum(top, 1)


def hue(b: int, g: int, r: int) -> int:
    """0..179: half the hue angle, rounded down; 0 without colour."""
    top, spread = max(b, g, r), max(b, g, r) - min(b, g, r)
    if not spread:
        return 0
    angle = 60.0 * (g - b) / spread if top == r else 120 + 60.0 * (b - r) / spread if top == g else 240 + 60.0 * (r - g) / spread
    return int(angle % 360 // 2)


def binomial5(img: np.ndarray) -> np.ndarray:
    """Gaussian mean over 5 x 5 with the weights 1 4 6 4 1, rounded; beyond the edge the page goes on mirrored at its outermost pixels."""
    pad = np.pad(img.astype(np.int32), 2, mode="reflect" if min(img.shape) > 2 else "edge")
    weights = (1, 4, 6, 4, 1)
    rows = sum(k * pad[:, i : i + img.shape[1]] for i, k in enumerate(weights))
    return (sum(k * rows[i : i + img.shape[0]] for i, k in enumerate(weights)) + 128) // 256


def colour_mask(bgr: np.ndarray) -> np.ndarray:
    """Coloured regions: saturated pixels that a 9 x 9 ellipse can reach inside the mask, so that chroma noise goes."""
    return opening(saturation(bgr) > SATURATION, ellipse(9))


def text_mask(gray: np.ndarray) -> np.ndarray:
    """Strong local contrast, smoothed to coherent text."""
    return binomial5(dilate(gray, BOX3) - erode(gray, BOX3)) > GRADIENT


def gray_masks(bgr: np.ndarray, gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mid-gray pixels, and those of them away from any stroke."""
    mid = (channel_spread(bgr)[1] <= ACHROMATIC) & (gray > MID_LOW) & (gray < MID_HIGH)
    return mid, mid & ~dilate(gray < INK, BOX7)


def areas(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the mask's components, the labels that occur and their areas."""
    label = label_mask(mask)
    ids, n = np.unique(label[label >= 0], return_counts=True)
    return label, ids, n


def largest_share(mask: np.ndarray) -> float:
    return float(areas(mask)[2].max(initial=0)) / mask.size


def page_class(colour_blob: float, gray_blob: float, text: float) -> str:
    if colour_blob > BLOB:
        return "mixed" if text > 0.03 else "color-text" if text > 0.01 else "color-image"
    if gray_blob > BLOB:
        return "gray-text" if text > 0.005 else "gray-image"
    return "bw-text"


def features(bgr: np.ndarray) -> tuple[str, float, float, float, float, float]:
    """Class, colour, text and gray ratios, and the largest coloured and gray components as shares of the page."""
    gray = luma(bgr)
    colour, text = colour_mask(bgr), text_mask(gray)
    mid, content = gray_masks(bgr, gray)
    blobs = largest_share(colour), largest_share(content)
    ratio = float(text.mean())
    return page_class(*blobs, ratio), float(colour.mean()), ratio, float(mid.mean()), *blobs


def blob_profile(mask: np.ndarray, gray: np.ndarray, most: int = 3) -> list[tuple[int, float, float, float, bool]]:
    """The largest components of a mask (equal ones by their labels): area, mean gray, its deviation, how much darker than paper (the page's 90th percentile), and whether within a hundredth of the border (4 pixels at least)."""
    label, ids, _ = areas(mask)
    if not len(ids):
        return []
    y, x = np.nonzero(mask)
    own = np.searchsorted(ids, label[mask])
    v = gray[mask].astype(np.float64)
    n = np.bincount(own)
    mean = np.bincount(own, v) / n
    std = np.sqrt(np.bincount(own, (v - mean[own]) ** 2) / n)
    h, w = mask.shape
    margin = max(4, min(h, w) // 100)
    edge = np.bincount(own, (y <= margin) | (x <= margin) | (y >= h - margin - 1) | (x >= w - margin - 1)) > 0
    paper = float(np.percentile(gray, 90))
    top = np.lexsort((ids, -n))[:most]
    return [(int(n[i]), float(mean[i]), float(std[i]), paper - float(mean[i]), bool(edge[i])) for i in top]


def strict_class(colour_blob: float, blobs: list[tuple[int, float, float, float, bool]], text: float) -> str:
    """page_class() where gray counts as a figure only if one of the blobs is clearly darker than paper and no flat wash."""
    return page_class(colour_blob, float(any(b[3] > DARKER and b[2] > UNEVEN for b in blobs)), text)


def figures(mask: np.ndarray) -> np.ndarray:
    """Components of FIGURE of the page or more, widened by a 9 x 9 ellipse."""
    label, ids, n = areas(mask)
    large = np.isin(label, ids[n >= FIGURE * mask.size])
    return dilate(large, ellipse(9)) if large.any() else large


def without_specks(mask: np.ndarray, least: int = SPECK) -> np.ndarray:
    label, ids, n = areas(mask)
    return np.isin(label, ids[n >= least])


def edge_mask(gray: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Edges: gradients (absolute sums of 3 x 3 Sobel derivatives) that are largest along their direction, over `low` and connected to one over `high`."""
    gx, gy = sobel(gray)
    size = np.abs(gx) + np.abs(gy)
    pad = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(gy) * 2 < np.abs(gx), np.abs(gx) * 2 < np.abs(gy)
    rising = (gx > 0) == (gy > 0)
    before = np.select([flat, steep, rising], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, rising], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    thin = (size > low) & (size > before) & (size >= after)
    label, _, _ = areas(thin)
    return np.isin(label, np.unique(label[thin & (size > high)])) & thin


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pad = np.pad(gray.astype(np.int32), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    h, w = gray.shape
    at = lambda dy, dx: pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = sum(k * (at(d, 1) - at(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(1, d) - at(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    return gx, gy


def sharpness(gray: np.ndarray, least: int = 100) -> float:
    """Variance of the Laplacian over the page's edges; 0 with fewer than `least` edge pixels."""
    edges = edge_mask(gray)
    if edges.sum() < least:
        return 0.0
    pad = np.pad(gray.astype(np.float64), 1, mode="reflect")
    laplacian = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * pad[1:-1, 1:-1]
    return float(laplacian[edges].var())


def _weights(kind: str, t: np.ndarray) -> np.ndarray:
    """Weight of a sample at distance t for each kernel."""
    t = np.abs(t)
    if kind == "linear":
        return np.maximum(1 - t, 0)
    if kind == "cubic":  # Keys' kernel with a = -0.75
        a = -0.75
        return np.select([t <= 1, t < 2], [(a + 2) * t**3 - (a + 3) * t**2 + 1, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a], 0.0)
    return np.where(t < 4, np.sinc(t) * np.sinc(t / 4), 0.0)  # lanczos


REACH = {"linear": 1, "cubic": 2, "lanczos": 4}


def _taps(old: int, new: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Source places and weights (new x taps) along one side; places beyond the edge are the edge's."""
    if kind not in REACH:
        raise ValueError(f"no kernel {kind!r}; there are {sorted(REACH)}, nearest and area")
    at = (np.arange(new) + 0.5) * old / new - 0.5
    first = np.floor(at).astype(int) - REACH[kind] + 1
    place = first[:, None] + np.arange(2 * REACH[kind])
    weight = _weights(kind, at[:, None] - place)
    return place.clip(0, old - 1), weight / weight.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    """A gray or colour page in another size: nearest, linear, cubic, lanczos (four lobes), or area means for sizes that shrink."""
    h, w = img.shape[:2]
    if kind == "nearest":
        return img[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]
    if kind == "area":
        return np.rint(_area(_area(img.astype(np.float64), height).swapaxes(0, 1), width).swapaxes(0, 1)).clip(0, 255).astype(np.uint8)
    out = img.astype(np.float64)
    for axis, (old, new) in enumerate(((h, height), (w, width))):
        place, weight = _taps(old, new, kind)
        out = np.moveaxis(np.einsum("nt,nt...->n...", weight, np.moveaxis(out, axis, 0)[place]), 0, axis)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def _area(rows: np.ndarray, new: int) -> np.ndarray:
    """Means over the exact shares of the rows that fall to each new row."""
    old = len(rows)
    upto = np.concatenate([np.zeros((1, *rows.shape[1:])), np.cumsum(rows, axis=0)])
    edge = np.arange(new + 1) * old / new
    low = np.minimum(edge.astype(int), old - 1)
    total = upto[low] + (edge - low).reshape(-1, *[1] * (rows.ndim - 1)) * rows[low]
    return np.diff(total, axis=0) / (old / new)


def pad_to_multiple(img: np.ndarray, k: int = 8) -> tuple[np.ndarray, int, int]:
    """The page with its top and left edges repeated until both sides are multiples of k, and by how much."""
    top, left = -img.shape[0] % k, -img.shape[1] % k
    return np.pad(img, ((top, 0), (left, 0), *[(0, 0)] * (img.ndim - 2)), mode="edge"), top, left


def divided(img: np.ndarray, shade: np.ndarray) -> np.ndarray:
    """A page relative to its shade: clip(255 * page / shade), where a shade of zero counts as a hundred-thousandth."""
    return np.clip(255.0 * img / np.where(shade == 0, 1e-5, shade), 0, 255).astype(np.uint8)


def tiled(img: np.ndarray, f: Callable[[np.ndarray], np.ndarray], tile: int, overlap: int, scale: int = 1) -> np.ndarray:
    """f over tiles of a page, blended by weights that fall linearly towards the tiles' edges; f gives tiles `scale` times as large."""
    h, w = img.shape[:2]
    starts = lambda n: sorted({*range(0, max(n - tile, 0) + 1, max(1, tile - overlap)), max(n - tile, 0)})
    total, weight = np.zeros((h * scale, w * scale, *img.shape[2:])), np.zeros((h * scale, w * scale, *[1] * (img.ndim - 2)))
    for y in starts(h):
        for x in starts(w):
            got = f(img[y : y + tile, x : x + tile]).astype(np.float64)
            ramp = [np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) for n in got.shape[:2]]
            own = np.minimum(ramp[0], max(1, overlap * scale))[:, None] * np.minimum(ramp[1], max(1, overlap * scale))
            own = own.reshape(*own.shape, *[1] * (img.ndim - 2)).astype(np.float64)
            at = np.s_[y * scale : y * scale + got.shape[0], x * scale : x * scale + got.shape[1]]
            total[at] += got * own
            weight[at] += own
    return np.rint(total / np.maximum(weight, 1e-8)).clip(0, 255).astype(np.uint8)


FEATURES = "page long, type string, color_ratio double, text_ratio double, gray_ratio double, color_blob double, gray_blob double, sharpness double"


def classified(pages: DataFrame) -> DataFrame:
    """FEATURES of each page (page, h, w, data); the columns are null for pages that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.float64()] * 6]
        for b in batches:
            rows = []
            for page, h, w, data in zip(*(c for c in b.columns)):
                img = decode(data.as_py(), h.as_py(), w.as_py())
                rows.append((page.as_py(), *([None] * 7 if img is None else [*features(img), sharpness(luma(img))])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return pages.select("page", "h", "w", "data").mapInArrow(run, FEATURES)


BLOBS = "array<struct<area:long,mean:double,std:double,darkness:double,border:boolean>>"


def diagnosed(pages: DataFrame) -> DataFrame:
    """page, type, strict (the stricter class) and blobs (the three largest gray regions) of each page; null for pages that can't be read."""
    blob = pa.struct([("area", pa.int64()), ("mean", pa.float64()), ("std", pa.float64()), ("darkness", pa.float64()), ("border", pa.bool_())])

    def one(page: int, img: np.ndarray | None) -> tuple:
        if img is None:
            return page, None, None, None
        gray = luma(img)
        kind, _, text, _, colour, _ = features(img)
        blobs = blob_profile(gray_masks(img, gray)[1], gray)
        return page, kind, strict_class(colour, blobs, text), [dict(zip((f.name for f in blob), b)) for b in blobs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(page.as_py(), decode(data.as_py(), h.as_py(), w.as_py())) for page, h, w, data in zip(*b.columns)]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(blob))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page", "type", "strict", "blobs"])

    return pages.select("page", "h", "w", "data").mapInArrow(run, f"page long, type string, strict string, blobs {BLOBS}")
