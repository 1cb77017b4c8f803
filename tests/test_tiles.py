"""Operators over tiles against plain loops, for any size of tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.operators import components, contraction, pages, raster
from quirelake.operators import tiles as T


def pixels(spark, planes):
    """Pixel rows of {page: {name: plane}}."""
    rows, names = [], list(next(iter(planes.values())))
    for page, p in planes.items():
        h, w = p[names[0]].shape
        rows += [(page, y, x, *(int(p[n][y, x]) for n in names)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "page long, y int, x int, " + ", ".join(f"{n} int" for n in names)).repartition(5)


def back(df, value, shapes):
    out = {k: np.full(s, -7) for k, s in shapes.items()}
    for r in df.collect():
        assert out[r.page][r.y, r.x] == -7
        out[r.page][r.y, r.x] = r[value]
    return out


def flood(mask):
    h, w = mask.shape
    label = np.full((h, w), -1)
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x] < 0:
            todo = [(y, x)]
            label[y, x] = y * w + x
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(h, a + 2)):
                    for d in range(max(0, b - 1), min(w, b + 2)):
                        if mask[c, d] and label[c, d] < 0:
                            label[c, d] = label[y, x]
                            todo.append((c, d))
    return label


def snake(h, w):
    """One path that runs to and fro over the whole plane."""
    m = np.zeros((h, w), bool)
    m[::2] = True
    for i, y in enumerate(range(1, h - 1, 2)):
        m[y, -1 if i % 2 == 0 else 0] = True
    return m


@pytest.mark.parametrize("size", [3, 4, 64])
def test_labels_equal_flood_fill(spark, size):
    rng = np.random.default_rng(size)
    w = 17
    masks = {1: rng.random((21, w)) < 0.45, 2: snake(21, w), 3: np.zeros((5, w), bool), 4: np.ones((9, w), bool), 5: np.eye(17, dtype=bool)[:, ::-1]}
    px = pixels(spark, {k: {"m": v} for k, v in masks.items()}).withColumn("m", F.col("m") == 1)
    got = back(components.labels(px, "m", w, size=size), "label", {k: v.shape for k, v in masks.items()})
    for k, m in masks.items():
        assert (got[k][m] == flood(m)[m]).all() and (got[k][~m] == -7).all()


def test_no_tile_holds_more_than_its_pixels_and_margin(spark):
    px = pixels(spark, {1: {"v": np.arange(900).reshape(30, 30)}})
    for size, reach in ((7, 0), (7, 3), (4, 9)):
        held = [len(r.pixels) for r in T.cut(px, ["v"], size, reach).collect()]
        assert len(held) == (-(-30 // size)) ** 2 and max(held) <= (size + 2 * reach) ** 2
    assert T.cut(px.limit(0), ["v"], 4, 2).count() == 0


@pytest.mark.parametrize("size,k", [(5, 9), (16, 9), (4, 3)])
def test_opening_and_median_do_not_depend_on_tiles(spark, size, k):
    rng = np.random.default_rng(k)
    planes = {1: rng.integers(0, 256, (23, 19)), 2: rng.integers(0, 256, (3, 40))}
    px, shapes = pixels(spark, {p: {"gray": v} for p, v in planes.items()}), {p: v.shape for p, v in planes.items()}
    at = pages.offsets(raster.ellipse(k))
    opened = back(T.over(px, ["gray"], lambda t: {"gray": T.opened(t.planes["gray"], t.there, at)}, {"gray": "int"}, size, 2 * (k // 2)), "gray", shapes)
    middle = back(pages.median(px, "gray", k, size), "gray", shapes)
    for p, v in planes.items():
        inside = lambda f, src: np.array([[f([src[y + a, x + b] for a, b in at if 0 <= y + a < v.shape[0] and 0 <= x + b < v.shape[1]]) for x in range(v.shape[1])] for y in range(v.shape[0])])
        assert (opened[p] == inside(max, inside(min, v))).all()
        pad = np.pad(v, k // 2, mode="edge")
        assert (middle[p] == [[np.median(pad[y : y + k, x : x + k]) for x in range(v.shape[1])] for y in range(v.shape[0])]).all()


def test_masks_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(8)
    planes = {p: {c: np.kron(rng.integers(0, 2, (9, 11)) * 200 + 30, np.ones((4, 4), int)) for c in "bgr"} for p in (1, 2)}
    px = pixels(spark, planes)
    one = {tuple(r) for r in pages.masks(px, 64).collect()}
    assert one == {tuple(r) for r in pages.masks(px, 8).collect()} and len(one) == 2 * 36 * 44
    assert {c: len({r[i] for r in one}) for i, c in enumerate(("colour", "text", "mid", "content"), 3)}["text"] == 2


def test_roots_of_long_chains_and_hubs(spark):
    chain = [(1, i, i + 1) for i in range(300)] + [(2, 5, i) for i in range(6, 200)] + [(3, 9, 9), (3, 2, 8), (3, 8, 2)]
    got = {(r.page, r.node): r.root for r in contraction.roots(spark.createDataFrame(chain, "page long, u long, v long"), ["page"]).collect()}
    assert got == {(1, i): 0 for i in range(301)} | {(2, i): 5 for i in range(5, 200)} | {(3, 2): 2, (3, 8): 2}
    assert contraction.roots(spark.createDataFrame([], "page long, u long, v long"), ["page"]).count() == 0
