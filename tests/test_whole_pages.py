"""Whole-page operators, layered encoding, files and stores against plain loops and round trips."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.operators import encode as E
from quirelake.operators import pageimage as I
from quirelake.operators import raster
from quirelake.sources import books, pdf


def scan(h=240, w=200, figure=True):
    """Strokes in black and red, and a coloured figure."""
    img = np.full((h, w, 3), 245, np.uint8)
    for y in range(20, h - 20, 20):
        for x in range(16, w - 16, 12):
            img[y : y + 11, x : x + 3] = (20, 20, 20) if x < w // 2 else (20, 20, 220)
    if figure:
        img[100:160, 60:120] = (200, 120, 40)
    return img


def loop_opening(mask, k):
    def fold(m, f):
        out = np.zeros_like(m)
        r = k.shape[0] // 2
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                out[y, x] = f(m[y + dy - r, x + dx - r] for dy, dx in np.argwhere(k) if 0 <= y + dy - r < m.shape[0] and 0 <= x + dx - r < m.shape[1])
        return out

    return fold(fold(mask, all), any)


def test_features_match_loops():
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (30, 26, 3)).astype(np.uint8)
    img[5:20, 5:18] = (40, 60, 200)
    assert (I.colour_mask(img) == loop_opening(I.saturation(img) > 45, raster.ellipse(9))).all()
    gray = I.luma(img)
    wide = img.astype(int)
    assert (gray == (114 * wide[..., 0] + 587 * wide[..., 1] + 299 * wide[..., 2]) // 1000).all()
    mask = gray < 90
    label, ids, n = I.areas(mask)
    assert n.sum() == mask.sum() and I.largest_share(mask) == n.max() / mask.size
    assert I.features(scan())[0] == "mixed" and I.features(scan(figure=False) // 255 * 255)[0] == "bw-text"
    plain = np.full((60, 60, 3), 128, np.uint8)
    assert I.features(plain)[0] == "gray-image" and I.features(np.full((60, 60, 3), (40, 60, 200), np.uint8))[0] == "color-image"


def test_strict_class_asks_for_dark_uneven_gray(spark):
    """A gray wash and a gray photo are figures for the classifier; for the stricter class only the photo is."""
    rng = np.random.default_rng(11)
    page = np.full((120, 100, 3), 250, np.uint8)
    wash, photo = page.copy(), page.copy()
    wash[30:90, 20:80] = 200
    photo[30:90, 20:80] = rng.integers(110, 190, (60, 60, 1))
    pages = [(i, 120, 100, bytearray(img.tobytes())) for i, img in enumerate((page, wash, photo))] + [(3, 120, 100, None)]
    got = {r.page: r for r in I.diagnosed(spark.createDataFrame(pages, "page long, h int, w int, data binary")).collect()}
    assert [got[i].type for i in range(4)] == ["bw-text", "gray-image", "gray-text", None]
    assert [got[i].strict for i in range(4)] == ["bw-text", "bw-text", "gray-text", None]
    assert got[0].blobs == [] and got[1].blobs[0] == (3600, 200.0, 0.0, 50.0, False)
    inner = photo[30:90, 20:80, 0].astype(float)
    assert got[2].blobs[0].area == 3600 and np.isclose(got[2].blobs[0].mean, inner.mean()) and np.isclose(got[2].blobs[0].std, inner.std())
    striped = np.full((90, 40), 200)
    striped[::2] = 80
    mask = np.zeros((90, 40), bool)
    mask[10:20, 10:20] = mask[60:70, 26:36] = mask[40:44, 2:6] = mask[30:32, 20:22] = True
    assert [(b[0], b[4]) for b in I.blob_profile(mask, striped.astype(np.uint8))] == [(100, False), (100, True), (16, True)]


def test_one_bit_pages_read_back_and_damage_is_found():
    img = I.luma(scan())
    data = raster.page_1bit(img)
    assert (raster.png_ink(data) == raster.adaptive(img, 35, 15)).all()
    for spoilt in (data[:40] + bytes([data[40] ^ 1]) + data[41:], data[1:]):
        with pytest.raises(ValueError):
            raster.png_ink(spoilt)


@pytest.mark.parametrize("k", [3, 9, 21])
def test_median_of_any_window(k):
    img = np.random.default_rng(k).integers(0, 256, (40, 33)).astype(np.uint8)
    pad = np.pad(img, k // 2, mode="edge")
    want = [[int(np.median(pad[y : y + k, x : x + k])) for x in range(img.shape[1])] for y in range(img.shape[0])]
    assert (raster.median(img, k) == want).all()


def test_resizing_padding_division_and_tiles():
    img = np.random.default_rng(5).integers(0, 256, (24, 36)).astype(np.uint8)
    assert (I.resize(img, 12, 18, "area") == np.rint(img.reshape(12, 2, 18, 2).mean(axis=(1, 3)))).all()
    assert (I.resize(img, 48, 72, "nearest") == img.repeat(2, 0).repeat(2, 1)).all()
    for kind in ("linear", "cubic", "lanczos"):
        assert (I.resize(img, 24, 36, kind) == img).all() and (I.resize(np.full((7, 9), 80, np.uint8), 31, 5, kind) == 80).all()
    ramp = np.tile(np.arange(0, 160, 10, dtype=np.uint8), (4, 1))
    assert (np.diff(I.resize(ramp, 4, 32, "linear").astype(int), axis=1) >= 0).all()
    with pytest.raises(ValueError):
        I.resize(img, 5, 5, "none")
    padded, top, left = I.pad_to_multiple(img[:21, :30])
    assert padded.shape == (24, 32) and (top, left) == (3, 2) and (padded[3:, 2:] == img[:21, :30]).all() and (padded[0, 2:] == img[0, :30]).all()
    assert I.divided(np.array([[10, 0]]), np.array([[0, 0]])).tolist() == [[255, 0]] and I.divided(np.array([[50]]), np.array([[100]])).tolist() == [[127]]
    assert (I.tiled(img, lambda t: t, 10, 3) == img).all() and (I.tiled(img, lambda t: t.repeat(2, 0).repeat(2, 1), 10, 3, 2) == img.repeat(2, 0).repeat(2, 1)).all()


def test_sharpness_falls_with_blur_and_needs_edges():
    gray = I.luma(scan())
    soft = np.rint(raster.gaussian(gray, 7)).astype(np.uint8)
    assert I.sharpness(gray) > I.sharpness(soft) > 0 and I.sharpness(np.full((50, 50), 9, np.uint8)) == 0


def test_layers_hold_the_text_by_colour():
    img = scan()
    back, layers = E.split_layers(img)
    assert [fill for _, fill in layers] == [(0, 0, 0), (20, 20, 220)]
    black, red = (m for m, _ in layers)
    assert black[20:31, 16:19].all() and not (black & red).any()
    assert (back[20:31, 16:19] == 255).all() and (back[110:150, 70:110] == (200, 120, 40)).all()  # text whitened, the figure kept
    p = E.encode_page(img, "mixed")
    assert p.kind == "layers" and p.size < E.whole_page(img, "mixed", E.Settings()).size and (p.w, p.h) == (100, 120)
    assert E.encode_page(img, "color-image").kind == "image" and E.encode_page(img, "gray-image").channels == 1
    one = E.encode_page(img, "bw-text")
    assert one.kind == "1bit" and one.data[:8] == raster.PNG
    assert E.layered_page(np.full((40, 40, 3), 200, np.uint8), "mixed", E.Settings()) is None
    E.STENCIL_CODECS["Broken"] = lambda bits, w, h: 1 / 0
    try:
        assert E.stencil(black, "Broken")[0] == E.stencil(black, "Absent")[0] == "FlateDecode"
    finally:
        del E.STENCIL_CODECS["Broken"]


def test_layers_through_files(spark, tmp_path):
    img = scan()
    rows = [(p, kind, *img.shape[:2], bytearray(img.tobytes())) for p, kind in ((1, "mixed"), (2, "color-image"), (3, "gray-image"))]
    enc = E.encoded(spark.createDataFrame(rows, "page long, type string, h int, w int, data binary"))
    books.write(enc.select(F.lit(1).cast("long").alias("book"), F.col("page").cast("int").alias("page"), F.lit(72.0).alias("width_pt"), F.lit(86.4).alias("height_pt"), *enc.columns[2:]), f"file://{tmp_path}/b")
    got = {r.page: r.images for r in books.read(spark, f"file://{tmp_path}/b").collect()}
    _, layers = E.split_layers(img)
    assert len(got[1]) == 1 + len(layers) and [x.mask for x in got[1]] == [False] + [True] * len(layers)
    for x, (mask, fill) in zip(got[1][1:], layers):
        assert (raster.unpack_bits(zlib.decompress(x.data), x.w, x.h) == mask).all() and x.fill == pdf.fill_operator(*fill)
    assert len(got[2]) == len(got[3]) == 1


def test_pages_that_cannot_be_read_have_null_features(spark):
    img = scan(60, 60, False)
    df = spark.createDataFrame([(1, 60, 60, bytearray(img.tobytes())), (2, 60, 60, None), (3, 60, 60, bytearray(b"x")), (4, None, 60, bytearray(b"x"))], "page long, h int, w int, data binary")
    got = {r.page: r for r in I.classified(df).collect()}
    assert got[1].type is not None and all(got[i].type is None and got[i].sharpness is None for i in (2, 3, 4))


def test_resampled_lines_match_plain_loops(spark):
    import random

    from quirelake.operators import pages as G

    rng = random.Random(5)
    px = [(p, y, x, rng.randrange(256)) for p in (1, 2, None) for y in range(11) for x in range(11) if p == 2 or (y != 4 and (y < 8 or x % 3))] + [(2, 3, 3, 7)]
    taps = [(k, i, min(max(i // 2 + d, 0), 10), w) for k, ws in (("near", {0: 1.0}), ("soft", {-1: 0.25, 0: 0.5, 1: 0.25})) for i in range(22) for d, w in ws.items()]
    want = {}
    for p, y, x, g in px:
        for k, i, src, w in taps if p else []:
            for k2, j, src2, w2 in taps:
                if k == k2 and src == y and src2 == x:
                    want[p, k, i, j] = want.get((p, k, i, j), 0) + w * w2 * g
    want = {at: min(max(round(v), 0), 255) for at, v in want.items()}
    rows = G.lines(spark.createDataFrame(px, "page long, y int, x int, gray int").repartition(3), "gray")
    table = spark.createDataFrame(taps, "kind string, i int, src int, w double")
    for size in (2, 5, 64):
        got = {(r.page, r.kind, r.y, x): g for r in G.resampled(rows, table, size).collect() for x, g in enumerate(r.grays) if g is not None}
        assert got == want
    assert G.resampled(rows.limit(0), table).count() == 0


def test_pages_of_vectors_meet_in_one_exchange(spark):
    from quirelake.plans import catalog

    for name, most in (("mosaic_resize", 1), ("mosaic_pad", 1)):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, plan


def test_odd_vectors_of_pages(spark, tmp_path):
    from quirelake.plans import fixtures

    e = [0.25] * 64
    rows = [(0, e), (0, [-0.5] * 64), (1, e[:10]), (2, [0.0] * 70), (17, []), (18, None), (None, e), (-1, [None] + e[1:])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in fixtures._gray_lines(spark, str(tmp_path)).collect():
        for x, g in zip(r.xs, r.grays):
            got.setdefault((r.page, r.y, x), []).append(g)
    assert {p for p, _, _ in got} == {0, -1} and len(got) == 2 * 1024
    assert sorted(got[0, 0, 0]) == [0, 192] and got[0, 0, 8] == [192] and got[0, 1, 10] == [255] and got[0, 0, 16] == [128] and got[0, 8, 21] == [128] and got[0, 8, 22] == [255]
    assert got[-1, 24, 24] == [0] and got[-1, 24, 25] == [192]
