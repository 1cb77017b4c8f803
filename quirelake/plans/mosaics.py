"""Queries over pages of 32 x 32 (F3): features, classes, figures, planes over tiles of 16 x 16; encoding as binary rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import components as CC
from ..operators import encode as E
from ..operators import pageimage as I
from ..operators import pages as G
from ..operators.raster import ellipse
from ..sources import pdf
from ..sources.shared import materialised
from .fixtures import MOSAIC, MOSAIC_SQL, PAGES_SQL, mosaic_lines, mosaic_pages, mosaic_pixels, page_rows
from .registry import query

#: Side of a tile, half a page's.
TILE = 16


def _gray(spark, sf_dir) -> DataFrame:
    return mosaic_pixels(spark, sf_dir).select("page", "y", "x", P.luma().alias("gray"))


def _masks(spark, sf_dir) -> DataFrame:
    return G.masks(mosaic_pixels(spark, sf_dir), TILE)


def _features(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    masks = materialised(_masks(spark, sf_dir), "masks")
    return G.features(masks, MOSAIC, TILE), masks


def _bits(rows: DataFrame, value: str) -> DataFrame:
    """page, y and each row's values as a string of digits."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda p: p[value].cast("string")), "")
    return rows.groupBy("page", "y").agg(line.alias("bits"))


_LAST = MOSAIC - 1


def _kernel(name: str, size: int) -> str:
    """SQL table of the offsets of an ellipse."""
    at = [(int(y) - size // 2, int(x) - size // 2) for y, x in zip(*ellipse(size).nonzero())]
    return f"{name}(dy, dx) AS (VALUES " + ", ".join(map(str, at)) + ")"


def _fold(out: str, fold: str, value: str, source: str, kernel: str) -> str:
    """Tables of the places that a kernel reaches from each pixel, written out first so that they are joined by all their keys, and of the folded values."""
    return f"""{out}_at AS MATERIALIZED (SELECT p.page, p.y, p.x, p.y + k.dy AS qy, p.x + k.dx AS qx FROM {source} p, {kernel} k),
{out} AS MATERIALIZED (SELECT p.page, p.y, p.x, {fold}(q.{value}) AS {value} FROM {out}_at p JOIN {source} q ON q.page = p.page AND q.y = p.qy AND q.x = p.qx GROUP BY p.page, p.y, p.x)"""


def _mirrored(c: str, d: str) -> str:
    return f"CASE WHEN p.{c} + {d} < 0 THEN -(p.{c} + {d}) WHEN p.{c} + {d} > {_LAST} THEN {2 * _LAST} - (p.{c} + {d}) ELSE p.{c} + {d} END"


_BOX = "(SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b)"
_TAPS = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"
_COLOUR = f"""{_kernel('ell9', 9)}, sat AS (SELECT page, y, x, (CASE WHEN hi = 0 THEN 0 ELSE 255 * spread // hi END > 45)::INT AS c FROM mc),
{_fold('era', 'min', 'c', 'sat', 'ell9')}, {_fold('opened', 'max', 'c', 'era', 'ell9')}"""
_TEXT = f"""grad AS (SELECT p.page, p.y, p.x, max(q.gray) - min(q.gray) AS v FROM mc p, {_BOX} k JOIN mc q ON q.page = p.page AND q.y = p.y + k.dy AND q.x = p.x + k.dx GROUP BY p.page, p.y, p.x),
across AS (SELECT p.page, p.y, p.x, sum(t.w * q.v) AS v FROM grad p, {_TAPS} t(d, w) JOIN grad q ON q.page = p.page AND q.y = p.y AND q.x = {_mirrored('x', 't.d')} GROUP BY p.page, p.y, p.x),
txt AS (SELECT p.page, p.y, p.x, ((sum(t.w * q.v) + 128) // 256 > 40)::INT AS t FROM across p, {_TAPS} t(d, w) JOIN across q ON q.page = p.page AND q.x = p.x AND q.y = {_mirrored('y', 't.d')} GROUP BY p.page, p.y, p.x)"""


@query("mosaic_ratios", f"""WITH {MOSAIC_SQL}, {_COLOUR}, {_TEXT}
SELECT m.page, avg(o.c::DOUBLE) AS color_ratio, avg(t.t::DOUBLE) AS text_ratio, avg((m.spread <= 12 AND m.gray > 40 AND m.gray < 220)::INT::DOUBLE) AS gray_ratio
FROM mc m JOIN opened o ON o.page = m.page AND o.y = m.y AND o.x = m.x JOIN txt t ON t.page = m.page AND t.y = m.y AND t.x = m.x GROUP BY m.page""")
def mosaic_ratios(spark, sf_dir):
    """Shares of the opened colour mask, the smoothed text mask and mid-gray, over pages of four tiles."""
    return G.ratios(_masks(spark, sf_dir)).drop("pixels")


#: Components of a mask on mosaics: the least label spreads to all eight neighbours, in rounds that outlast any path in it. `tag` keeps the tables of several masks apart.
def _spread(mask: str, source: str = "mc", tag: str = "") -> str:
    return f"""on_{tag} AS MATERIALIZED (SELECT page, y, x, y * {MOSAIC} + x AS own FROM {source} WHERE {mask}),
near{tag} AS MATERIALIZED (SELECT a.page, a.own, b.own AS other FROM on_{tag} a JOIN on_{tag} b ON b.page = a.page AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1),
lab{tag}(i, page, own, label) AS (SELECT 0, page, own, own FROM on_{tag} UNION ALL
  SELECT any_value(l.i) + 1, n.page, n.own, min(l.label) FROM near{tag} n JOIN lab{tag} l ON l.page = n.page AND l.own = n.other WHERE l.i < 160 GROUP BY n.page, n.own),
ar{tag} AS MATERIALIZED (SELECT page, label, count(*) AS area FROM lab{tag} WHERE i = 160 GROUP BY page, label)"""


_BOX7 = "(SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b)"
_CONTENT = f"""inkm AS (SELECT page, y, x, (gray < 100)::INT AS i FROM mc), {_fold('nearink', 'max', 'i', 'inkm', _BOX7)},
content AS (SELECT m.page, m.y, m.x, m.gray FROM mc m JOIN nearink n ON n.page = m.page AND n.y = m.y AND n.x = m.x WHERE n.i = 0 AND m.spread <= 12 AND m.gray > 40 AND m.gray < 220)"""
_GRAY_CLASS = "CASE WHEN color_blob > 0.0008 THEN CASE WHEN text_ratio > 0.03 THEN 'mixed' WHEN text_ratio > 0.01 THEN 'color-text' ELSE 'color-image' END WHEN {} THEN CASE WHEN text_ratio > 0.005 THEN 'gray-text' ELSE 'gray-image' END ELSE 'bw-text' END"
_CLASSES = f"""{_COLOUR}, {_TEXT}, {_CONTENT}, {_spread('c = 1', 'opened', '_c')}, {_spread('true', 'content', '_g')},
ratios AS (SELECT m.page, avg(o.c::DOUBLE) AS color_ratio, avg(t.t::DOUBLE) AS text_ratio, avg((m.spread <= 12 AND m.gray > 40 AND m.gray < 220)::INT::DOUBLE) AS gray_ratio
  FROM mc m JOIN opened o ON o.page = m.page AND o.y = m.y AND o.x = m.x JOIN txt t ON t.page = m.page AND t.y = m.y AND t.x = m.x GROUP BY m.page),
feat AS (SELECT r.*, coalesce(c.n, 0) / {MOSAIC * MOSAIC}::DOUBLE AS color_blob, coalesce(g.n, 0) / {MOSAIC * MOSAIC}::DOUBLE AS gray_blob FROM ratios r
  LEFT JOIN (SELECT page, max(area) AS n FROM ar_c GROUP BY page) c ON c.page = r.page LEFT JOIN (SELECT page, max(area) AS n FROM ar_g GROUP BY page) g ON g.page = r.page)"""
_BLOBS = f"""paper AS (SELECT page, quantile_cont(gray::DOUBLE, 0.9) AS p90 FROM mc GROUP BY page),
bl AS (SELECT l.page, l.label, count(*) AS area, avg(c.gray::DOUBLE) AS mean, stddev_pop(c.gray::DOUBLE) AS std, bool_or(least(c.y, c.x) <= 4 OR greatest(c.y, c.x) >= {MOSAIC - 5}) AS border
  FROM lab_g l JOIN content c ON c.page = l.page AND c.y * {MOSAIC} + c.x = l.own WHERE l.i = 160 GROUP BY l.page, l.label),
prof AS (SELECT bl.page, (row_number() OVER (PARTITION BY bl.page ORDER BY area DESC, label))::INTEGER AS rank, area, round(mean, 6) AS mean, round(std, 6) AS std, round(p90 - mean, 6) AS darkness, border FROM bl JOIN paper ON paper.page = bl.page)"""


@query("mosaic_classify", f"WITH RECURSIVE {MOSAIC_SQL}, {_CLASSES} SELECT *, {_GRAY_CLASS.format('gray_blob > 0.0008')} AS type FROM feat")
def mosaic_classify(spark, sf_dir):
    """Full page classification: opened and smoothed masks, and the largest components."""
    return G.classified(_features(spark, sf_dir)[0])


@query("mosaic_sharpness")
def mosaic_sharpness(spark, sf_dir):
    return I.classified(mosaic_pages(spark, sf_dir)).select("page", "sharpness")


@query("mosaic_blobs", f"WITH RECURSIVE {MOSAIC_SQL}, {_CONTENT}, {_spread('true', 'content', '_g')}, {_BLOBS} SELECT * FROM prof WHERE rank <= 3")
def mosaic_blobs(spark, sf_dir):
    """The three largest gray regions of each page that lie away from strokes."""
    return G.blobs(mosaic_pixels(spark, sf_dir), _masks(spark, sf_dir), MOSAIC, MOSAIC, size=TILE)


@query("verdict_confusion", f"""WITH RECURSIVE {MOSAIC_SQL}, {_CLASSES}, {_BLOBS}, v AS (SELECT *, page IN (SELECT page FROM prof WHERE rank <= 3 AND darkness > 35 AND std > 12) AS figure FROM feat)
SELECT {_GRAY_CLASS.format('gray_blob > 0.0008')} AS current_verdict, {_GRAY_CLASS.format('figure')} AS strict_verdict, count(*) AS n FROM v GROUP BY ALL""")
def verdict_confusion(spark, sf_dir):
    """Pages by their class and by the stricter one."""
    features, masks = _features(spark, sf_dir)
    both = G.strict_type(features, G.blobs(mosaic_pixels(spark, sf_dir), masks, MOSAIC, MOSAIC, size=TILE))
    return both.groupBy(F.col("type").alias("current_verdict"), F.col("strict").alias("strict_verdict")).agg(F.count("*").alias("n"))


def _labels(spark, sf_dir, mask: str) -> DataFrame:
    """Components of a condition on gray, over tiles of half a page."""
    return CC.labels(_gray(spark, sf_dir).withColumn("m", F.expr(mask)), "m", MOSAIC, MOSAIC, TILE)


@query("mosaic_specks", f"WITH RECURSIVE {MOSAIC_SQL}, {_spread('gray < 128')} SELECT page, label::INTEGER AS label, area FROM ar WHERE area < {G.SPECK}")
def mosaic_specks(spark, sf_dir):
    """Components that are dropped as specks."""
    return CC.stats(_labels(spark, sf_dir, "gray < 128")).where(F.col("area") < G.SPECK).select("page", "label", "area")


@query("mosaic_figures", f"WITH RECURSIVE {MOSAIC_SQL}, {_spread('gray < 170')} SELECT page, label::INTEGER AS label, area FROM ar WHERE area >= {G.FIGURE} * {MOSAIC * MOSAIC}")
def mosaic_figures(spark, sf_dir):
    """Connected dark regions of 0.4 % of the page or more, which stay out of the text."""
    return CC.stats(_labels(spark, sf_dir, "gray < 170")).where(F.col("area") >= G.FIGURE * MOSAIC * MOSAIC).select("page", "label", "area")


def _encoded(spark, sf_dir) -> DataFrame:
    pages = mosaic_pages(spark, sf_dir)
    types = I.classified(pages).select("page", "type")
    return E.encoded(pages.join(types, "page"))


@query("mosaic_encode")
def mosaic_encode(spark, sf_dir):
    """Payload of each page by its class: kind, channels, layers with their fills, bytes."""
    fills = F.transform("layers", lambda x: F.struct(x["b"].alias("b"), x["g"].alias("g"), x["r"].alias("r")))
    return _encoded(spark, sf_dir).select("page", "type", "kind", "filter", "w", "h", "channels", F.size("layers").alias("n_layers"), fills.alias("fills"), "size")


def _held(c: str, d: str) -> str:
    """A place beyond the edge is the edge."""
    return f"least(greatest(p.{c} + {d}, 0), {_LAST})"


_REACH = 10


@query("mosaic_median", f"""WITH {MOSAIC_SQL}, d AS (SELECT unnest(range(-{_REACH}, {_REACH + 1}))::INTEGER AS d)
SELECT p.page, p.y, p.x, quantile_disc(q.gray, 0.5)::INTEGER AS gray FROM mc p, d a, d b JOIN mc q ON q.page = p.page AND q.y = {_held('y', 'a.d')} AND q.x = {_held('x', 'b.d')} GROUP BY p.page, p.y, p.x""")
def mosaic_median(spark, sf_dir):
    """Background shade: the median over 21 x 21."""
    return G.median(_gray(spark, sf_dir), "gray", 2 * _REACH + 1, TILE)


def _ink_sql(name: str, k: int, c: int) -> str:
    """Table `name` of the local threshold: not over the Gaussian mean of k x k less c."""
    s = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    return f"""t{k} AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d::INTEGER AS d, exp(-(d * d) / {2 * s * s}::DOUBLE) AS w FROM (SELECT unnest(range(-{k // 2}, {k // 2 + 1})) AS d))),
a{k} AS (SELECT p.page, p.y, p.x, sum(t.w * q.gray) AS v FROM mc p, t{k} t JOIN mc q ON q.page = p.page AND q.y = p.y AND q.x = {_held('x', 't.d')} GROUP BY p.page, p.y, p.x),
g{k} AS (SELECT p.page, p.y, p.x, sum(t.w * q.v) AS v FROM a{k} p, t{k} t JOIN a{k} q ON q.page = p.page AND q.x = p.x AND q.y = {_held('y', 't.d')} GROUP BY p.page, p.y, p.x),
{name} AS (SELECT m.page, m.y, m.x, (m.gray <= round_even(g.v, 0) - {c})::INTEGER AS ink FROM mc m JOIN g{k} g ON g.page = m.page AND g.y = m.y AND g.x = m.x)"""


@query("mosaic_ink", f"WITH {MOSAIC_SQL}, {_ink_sql('i', 25, 10)} SELECT page, y, x, ink FROM i")
def mosaic_ink(spark, sf_dir):
    """Ink by the local threshold of layers (25, 10)."""
    return G.local_ink(_gray(spark, sf_dir), 25, 10, TILE)


@query("mosaic_one_bit", f"WITH {MOSAIC_SQL}, {_ink_sql('i', 35, 15)} SELECT page, y, string_agg(ink::VARCHAR, '' ORDER BY x) AS bits FROM i GROUP BY page, y")
def mosaic_one_bit(spark, sf_dir):
    """Rows of pages in one bit a pixel, by the local threshold of text pages (35, 15)."""
    return _bits(G.local_ink(_gray(spark, sf_dir), 35, 15, TILE), "ink")


@query("mosaic_widened", f"""WITH RECURSIVE {MOSAIC_SQL}, {_kernel('ell9', 9)}, {_spread('gray < 170')},
large AS MATERIALIZED (SELECT m.page, m.y, m.x, (a.label IS NOT NULL)::INT AS c FROM mc m LEFT JOIN (SELECT * FROM lab WHERE i = 160) l ON l.page = m.page AND l.own = m.y * {MOSAIC} + m.x
  LEFT JOIN (SELECT * FROM ar WHERE area >= {G.FIGURE} * {MOSAIC * MOSAIC}) a ON a.page = l.page AND a.label = l.label), {_fold('wide', 'max', 'c', 'large', 'ell9')}
SELECT page, y, string_agg(c::VARCHAR, '' ORDER BY x) AS bits FROM wide GROUP BY page, y""")
def mosaic_widened(spark, sf_dir):
    """Figures of each page, widened by the 9 x 9 ellipse."""
    lab = _labels(spark, sf_dir, "gray < 170")
    large = CC.stats(lab).where(F.col("area") >= G.FIGURE * MOSAIC * MOSAIC).select("page", "label")
    inside = lab.join(large, ["page", "label"], "left_semi").select("page", "y", "x", F.lit(1).alias("in"))
    rows = _gray(spark, sf_dir).join(inside, ["page", "y", "x"], "left").select("page", "y", "x", F.coalesce("in", F.lit(0)).alias("m"))
    return _bits(G.widened(rows, "m", ellipse(9), TILE), "c")


@query("mosaic_pad", f"""WITH {MOSAIC_SQL}, p AS (SELECT page, y, x FROM (SELECT DISTINCT page FROM mc), (SELECT unnest(range({MOSAIC}))::INTEGER AS y), (SELECT unnest(range({MOSAIC}))::INTEGER AS x))
SELECT p.page, p.y, p.x, m.gray FROM p JOIN mc m ON m.page = p.page AND m.y = greatest(p.y - 3, 0) AND m.x = greatest(p.x - 5, 0)""")
def mosaic_pad(spark, sf_dir):
    """Pages without their last three rows and five columns, filled up to multiples of eight at the top and left."""
    return G.padded(_gray(spark, sf_dir).where(f"y < {MOSAIC - 3} AND x < {MOSAIC - 5}"), "gray", 3, 5)


_WEIGHT = """CASE kind WHEN 'linear' THEN greatest(1 - t, 0) WHEN 'cubic' THEN CASE WHEN t <= 1 THEN 1.25 * t * t * t - 2.25 * t * t + 1 WHEN t < 2 THEN -0.75 * t * t * t + 3.75 * t * t - 6 * t + 3 ELSE 0 END
  ELSE CASE WHEN t >= 4 THEN 0 ELSE 4 * sin(pi() * t) * sin(pi() * t / 4) / (pi() * pi() * t * t) END END"""


@query("mosaic_resize", f"""WITH {MOSAIC_SQL}, raw AS (SELECT kind, i::INTEGER AS i, least(greatest(j, 0), {_LAST})::INTEGER AS src, abs((i + 0.5::DOUBLE) / 2 - 0.5 - j) AS t
  FROM (SELECT unnest(['linear', 'cubic', 'lanczos']) AS kind), (SELECT unnest(range({2 * MOSAIC})) AS i), (SELECT unnest(range(-5, {MOSAIC + 5})) AS j)),
tap AS (SELECT kind, i, src, w / sum(w) OVER (PARTITION BY kind, i) AS w FROM (SELECT kind, i, src, {_WEIGHT} AS w FROM raw) WHERE w <> 0),
across AS (SELECT page, kind, y, i AS x, sum(w * gray) AS v FROM mc JOIN tap ON tap.src = mc.x GROUP BY page, kind, y, i),
down AS (SELECT page, a.kind, i AS y, a.x, sum(w * v) AS v FROM across a JOIN tap ON tap.kind = a.kind AND tap.src = a.y GROUP BY page, a.kind, i, a.x)
SELECT page, kind, y, string_agg(least(greatest(round_even(v, 0), 0), 255)::INTEGER::VARCHAR, ',' ORDER BY x) AS grays FROM down GROUP BY page, kind, y""")
def mosaic_resize(spark, sf_dir):
    """Pages twice as large by the linear, cubic and Lanczos kernels, row by row."""
    rows = G.resampled(mosaic_lines(spark, sf_dir), _taps(spark, 2 * MOSAIC), TILE)
    return rows.select("page", "kind", "y", F.array_join(F.transform("grays", lambda g: g.cast("string")), ",").alias("grays"))


def _taps(spark, new: int) -> DataFrame:
    """Weights (kind, i, src, w) of the kernels from a side of MOSAIC to one of `new` pixels, as columns of a range of places."""
    rows = spark.range(new).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(-5), F.lit(MOSAIC + 4))).alias("j"))
    t = F.abs((F.col("i") + 0.5) * MOSAIC / new - 0.5 - F.col("j"))
    cubic = F.when(t <= 1, 1.25 * t * t * t - 2.25 * t * t + 1).when(t < 2, -0.75 * t * t * t + 3.75 * t * t - 6 * t + 3).otherwise(0.0)
    lanczos = F.when(t >= 4, 0.0).when(t == 0, 1.0).otherwise(4 * F.sin(F.pi() * t) * F.sin(F.pi() * t / 4) / (F.pi() * F.pi() * t * t))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), w.alias("w")) for k, w in (("linear", F.greatest(1 - t, F.lit(0.0))), ("cubic", cubic), ("lanczos", lanczos))]))
    rows = rows.select("i", F.least(F.greatest("j", F.lit(0)), F.lit(_LAST)).alias("src"), kinds.alias("k")).select("i", "src", "k.*").where("w <> 0")
    return rows.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("kind", "i")))


@query("jpeg_headers", f"""WITH {PAGES_SQL} SELECT book, page, CASE WHEN page < 7 THEN px_w END AS w, CASE WHEN page < 7 THEN px_h END AS h, CASE WHEN page < 7 THEN CASE WHEN starts_with(ptype, 'gray') THEN 1 ELSE 3 END END AS components,
  CASE WHEN page < 7 THEN CASE WHEN starts_with(ptype, 'gray') THEN '1x1' ELSE '2x2,1x1,1x1' END END AS sampling FROM pg""")
def jpeg_headers(spark, sf_dir):
    """Size, components and sampling out of JPEG headers, made of an application segment, a table and a frame (progressive on even pages); the seventh page of a book has no frame."""
    number = lambda c: F.lpad(F.hex(c), 4, "0")
    parts = F.when(F.col("ptype").startswith("gray"), "01011100").otherwise("03012200021101031101")
    frame = F.concat(F.when(F.col("page") % 2 == 0, "FFC2").otherwise("FFC0"), number(8 + F.when(F.col("ptype").startswith("gray"), 3).otherwise(9)), F.lit("08"), number(F.col("px_h")), number(F.col("px_w")), parts)
    data = F.unhex(F.concat(F.lit("FFD8FFE000044A46FFC40003FF"), F.when(F.col("page") < 7, frame).otherwise(""), F.lit("FFD9")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pdf.jpeg_header(x) or (None,) * 4 for x in b.column(2).to_pylist()]
            more = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=["book", "page", "w", "h", "components", "sampling"])

    return page_rows(spark, sf_dir).select("book", "page", data.alias("data")).mapInArrow(run, "book long, page int, w int, h int, components int, sampling string")
