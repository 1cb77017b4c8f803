"""Page-binary operators against plain loops, files against their reader, streams against batches."""

import json
import zlib

import numpy as np
import pytest

from quirelake.functions import backends
from quirelake.operators import components, raster
from quirelake.sources import pdf


def page(seed, h=23, w=19):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


def brute_fold(img, kernel, fold):
    r = kernel.shape[0] // 2
    at = lambda y, x: [int(img[y + dy - r, x + dx - r]) for dy, dx in np.argwhere(kernel) if 0 <= y + dy - r < img.shape[0] and 0 <= x + dx - r < img.shape[1]]
    return np.array([[fold(at(y, x)) for x in range(img.shape[1])] for y in range(img.shape[0])])


def test_morphology_matches_loops():
    img, k = page(1), raster.ellipse(5)
    assert (raster.dilate(img, k) == brute_fold(img, k, max)).all() and (raster.erode(img, k) == brute_fold(img, k, min)).all()
    opened = raster.opening(img, k)
    assert (opened <= img).all() and (raster.opening(opened, k) == opened).all()


def test_median_and_threshold():
    img = page(2)
    pad = np.pad(img, 2, mode="edge")
    want = [[int(np.median(pad[y : y + 5, x : x + 5])) for x in range(img.shape[1])] for y in range(img.shape[0])]
    assert (raster.median(img, 5) == want).all() and raster.median(img, 0) is img
    flat = np.full((9, 9), 77, np.uint8)
    assert np.allclose(raster.gaussian(flat, 5), 77) and not raster.adaptive(flat, 5, 10).any()


@pytest.mark.parametrize("w", [1, 7, 8, 9, 24])
def test_bits_round_trip(w):
    ink = page(3, 6, w) < 128
    data = raster.pack_bits(ink)
    assert (raster.unpack_bits(data, w, 6) == ink).all() and raster.unpack_bits(data[:-1], w, 6) is None
    png = raster.png_gray(np.frombuffer(data, np.uint8).reshape(6, -1), w)
    start = png.index(b"IDAT") + 4
    lines = zlib.decompress(png[start : png.index(b"IEND") - 8])
    stride = -(-w // 8)
    assert b"".join(lines[y * (stride + 1) + 1 : (y + 1) * (stride + 1)] for y in range(6)) == data
    assert png[:8] == raster.PNG and png[16:26] == bytes([0, 0, 0, w, 0, 0, 0, 6, 1, 0])
    with pytest.raises(ValueError):
        raster.png_gray(np.zeros((6, stride + 1), np.uint8), w)


def test_components_match_flood_fill():
    mask = page(4, 20, 20) < 110
    got = components.label_mask(mask)
    seen = np.full(mask.shape, -1)
    for y, x in np.argwhere(mask):
        if seen[y, x] < 0:
            todo, own = [(y, x)], y * 20 + x
            while todo:
                a, b = todo.pop()
                if 0 <= a < 20 and 0 <= b < 20 and mask[a, b] and seen[a, b] < 0:
                    seen[a, b] = own
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert (got == seen).all()


def test_layers_keep_thin_strokes_and_drop_specks():
    img = np.full((40, 40), 240, np.uint8)
    img[10:12, 4:36] = 20  # a stroke of two pixels stays
    img[30, 30] = 20  # a speck goes
    stencil, back = raster.split_layers(img)
    ink = raster.unpack_bits(zlib.decompress(stencil), 40, 40)
    assert ink[10:12, 4:36].all() and ink.sum() == 64
    assert len(zlib.decompress(back)) == 400


def test_pages_through_backends(spark):
    img = page(5)
    df = spark.createDataFrame([(1, 23, 19, bytearray(img.tobytes())), (2, 23, 19, None), (3, 23, 19, bytearray(b"short"))], "page long, h int, w int, data binary")
    got = {r.page: r for r in backends.enhanced(df, "background", "repeat", scale=2).collect()}
    assert (got[1].h, got[1].w, len(got[1].data)) == (46, 38, 46 * 38) and got[2].data is None and got[3].data is None
    assert bytes(backends.enhanced(df).where("page = 1").first().data) == img.tobytes()
    with pytest.raises(KeyError, match="background"):
        backends.create("restore", "absent")


def test_jpeg_header():
    frame = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x11\x08\x00\x14\x00\x0a\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01"
    assert pdf.jpeg_header(frame) == (10, 20, 3, "2x2,1x1,1x1")
    assert pdf.jpeg_header(None) is None and pdf.jpeg_header(b"no") is None and pdf.jpeg_header(frame[:14]) is None


def test_streamed_progress_equals_batch(spark, tmp_path):
    from quirelake.plans.jobs import log_progress
    from quirelake.plans.fixtures import log_rows
    from quirelake.streaming.jobs import job_progress

    sf_dir = "/root/testdata/sf0.001"
    log = log_rows(spark, sf_dir).select("job", "seq", "line").where("job % 7 = 0")
    for i in range(2):
        log.where(f"seq % 2 = {i}" if i else "seq % 2 = 0").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    last = {}

    def keep(batch, _):
        last.update({r.job: r for r in batch.collect()})

    stream = spark.readStream.schema("job long, seq long, line string").json(str(tmp_path / "log"))
    q = job_progress(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {}
    for r in log_progress(spark, sf_dir).where("job % 7 = 0").orderBy("seq").collect():
        want[r.job] = (r.seq, r.progress, r.stage)
    assert {j: (r.seq, r.progress, r.stage) for j, r in last.items()} == want


def test_page_checkpoints_resume(spark, tmp_path):
    from quirelake.streaming.jobs import checkpoint_pages

    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"sig": "a", "page": p}) for p in range(i, i + 3)))
        pages = spark.readStream.schema("sig string, page int").json(str(tmp_path / "in"))
        checkpoint_pages(pages, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.page for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [0, 1, 2, 3]
