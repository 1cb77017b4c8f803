"""Queries over pixels: masks, neighbourhoods, components, layers, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import classify as C
from ..operators import components as CC
from ..operators import neighbourhood as N
from ..operators import pages as G
from ..operators.raster import ellipse
from ..sources.shared import materialised
from .fixtures import BGR_SQL, GRAY_SQL, SIDE, bgr_pixels, gray_pixels, table
from .registry import query

AREA = SIDE * SIDE


def _frame(value: str, fold: str, k: int, source: str, out: str) -> str:
    """SQL of a box fold: two window steps named out_r and out."""
    return f"""{out}_r AS (SELECT *, {fold}({value}) OVER (PARTITION BY page, y ORDER BY x RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS {out}_v FROM {source}),
{out} AS (SELECT * EXCLUDE ({out}_v), {fold}({out}_v) OVER (PARTITION BY page, x ORDER BY y RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS {out}_o FROM {out}_r)"""


def ellipse_sql(name: str, size: int) -> str:
    """SQL table of the offsets of an ellipse."""
    at = [(int(y) - size // 2, int(x) - size // 2) for y, x in zip(*ellipse(size).nonzero())]
    return f"{name}(dy, dx) AS (VALUES " + ", ".join(map(str, at)) + ")"


def fold_sql(out: str, fold: str, value: str, source: str, kernel: str) -> str:
    """Tables of the places that a kernel reaches from each pixel, written out first so that they are joined by all their keys, and of the folded values."""
    return f"""{out}_at AS MATERIALIZED (SELECT p.page, p.y, p.x, p.y + k.dy AS qy, p.x + k.dx AS qx FROM {source} p, {kernel} k),
{out} AS MATERIALIZED (SELECT p.page, p.y, p.x, {fold}(q.{value}) AS {value} FROM {out}_at p JOIN {source} q ON q.page = p.page AND q.y = p.qy AND q.x = p.qx GROUP BY p.page, p.y, p.x)"""


def _mirrored(c: str) -> str:
    return f"CASE WHEN p.{c} + t.d < 0 THEN -(p.{c} + t.d) WHEN p.{c} + t.d > {SIDE - 1} THEN {2 * SIDE - 2} - (p.{c} + t.d) ELSE p.{c} + t.d END"


_WEIGHTS = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"


def _cc(mask: str, source: str, tag: str = "") -> str:
    """Recursive SQL: lab(page, y, x, label) of the pixels of source under mask. `tag` keeps the tables of several masks apart."""
    return f"""on_{tag} AS (SELECT page, y, x FROM {source} WHERE {mask}),
reach{tag} AS (SELECT page, y, x, y AS ty, x AS tx FROM on_{tag} UNION SELECT r.page, r.y, r.x, o.y, o.x FROM reach{tag} r JOIN on_{tag} o ON o.page = r.page AND abs(o.y - r.ty) <= 1 AND abs(o.x - r.tx) <= 1),
lab{tag} AS (SELECT page, y, x, min(ty * 8 + tx)::INTEGER AS label FROM reach{tag} GROUP BY page, y, x)"""


#: Masks of F2 pages: colour opened by the 9 x 9 ellipse, gradient smoothed over 5 x 5, mid-gray away from ink.
MASK_SQL = (
    BGR_SQL
    + f", {ellipse_sql('ell9', 9)}, sat AS (SELECT page, y, x, (CASE WHEN hi = 0 THEN 0 ELSE 255 * spread // hi END > 45)::INT AS c FROM col), {fold_sql('era', 'min', 'c', 'sat', 'ell9')}, {fold_sql('opened', 'max', 'c', 'era', 'ell9')}, "
    + "m0 AS (SELECT *, CASE WHEN gray < 100 THEN 1 ELSE 0 END AS ink FROM col), "
    + ", ".join([_frame("ink", "max", 3, "m0", "near"), _frame("gray", "max", 1, "near", "top"), _frame("gray", "min", 1, "top", "low")])
    + f""", gd AS (SELECT page, y, x, top_o - low_o AS v FROM low),
ac AS (SELECT p.page, p.y, p.x, sum(t.w * q.v) AS v FROM gd p, {_WEIGHTS} t(d, w) JOIN gd q ON q.page = p.page AND q.y = p.y AND q.x = {_mirrored('x')} GROUP BY p.page, p.y, p.x),
tx AS (SELECT p.page, p.y, p.x, (sum(t.w * q.v) + 128) // 256 > 40 AS t FROM ac p, {_WEIGHTS} t(d, w) JOIN ac q ON q.page = p.page AND q.x = p.x AND q.y = {_mirrored('y')} GROUP BY p.page, p.y, p.x),
mk AS (SELECT l.page, l.y, l.x, o.c = 1 AS colour, tx.t AS text, l.spread <= 12 AND l.gray > 40 AND l.gray < 220 AND l.near_o = 0 AS content_gray
  FROM low l JOIN opened o ON o.page = l.page AND o.y = l.y AND o.x = l.x JOIN tx ON tx.page = l.page AND tx.y = l.y AND tx.x = l.x),
ft AS (SELECT page, avg(colour::INT::DOUBLE) AS color_ratio, avg(text::INT::DOUBLE) AS text_ratio, avg(content_gray::INT::DOUBLE) AS gray_ratio, bool_or(colour) AS colour_any, bool_or(content_gray) AS gray_any FROM mk GROUP BY page)"""
)
#: Largest components of both masks, as shares of the page.
BLOB_SQL = f"""{_cc('colour', 'mk', '_c')}, {_cc('content_gray', 'mk', '_g')},
bc AS (SELECT page, max(n) / 64.0::DOUBLE AS blob FROM (SELECT page, label, count(*) AS n FROM lab_c GROUP BY ALL) GROUP BY page), bg AS (SELECT page, max(n) / 64.0::DOUBLE AS blob FROM (SELECT page, label, count(*) AS n FROM lab_g GROUP BY ALL) GROUP BY page)"""
TYPE_SQL = "CASE WHEN coalesce(bc.blob, 0) > 0.0008 THEN CASE WHEN text_ratio > 0.03 THEN 'mixed' WHEN text_ratio > 0.01 THEN 'color-text' ELSE 'color-image' END WHEN coalesce(bg.blob, 0) > 0.0008 THEN CASE WHEN text_ratio > 0.005 THEN 'gray-text' ELSE 'gray-image' END ELSE 'bw-text' END"


def _masks(spark, sf_dir) -> DataFrame:
    on = lambda c, name: (F.col(c) == 1).alias(name)
    return G.masks(bgr_pixels(spark, sf_dir), SIDE).select("page", "y", "x", on("colour", "colour"), on("text", "text"), on("content", "content_gray"))


def _ratios(masks: DataFrame) -> DataFrame:
    return masks.groupBy("page").agg(P.share("colour").alias("color_ratio"), P.share("text").alias("text_ratio"), P.share("content_gray").alias("gray_ratio"))


@query("mask_ratios", f"WITH {MASK_SQL} SELECT page, color_ratio, text_ratio, gray_ratio FROM ft")
def mask_ratios(spark, sf_dir):
    return _ratios(_masks(spark, sf_dir))


@query("page_classify", f"WITH RECURSIVE {MASK_SQL}, {BLOB_SQL} SELECT ft.page, color_ratio, text_ratio, gray_ratio, {TYPE_SQL} AS type FROM ft LEFT JOIN bc ON bc.page = ft.page LEFT JOIN bg ON bg.page = ft.page")
def page_classify(spark, sf_dir):
    """Six-way class of each page by opened and smoothed masks and the largest component of each."""
    masks = materialised(_masks(spark, sf_dir), "masks")
    ratios = _ratios(masks)
    blob = lambda c: CC.largest_ratio(ratios.select("page"), CC.labels(masks, c, SIDE, SIDE, SIDE), AREA).withColumnRenamed("ratio", f"blob_{c}")
    rows = ratios.join(blob("colour"), "page").join(blob("content_gray"), "page")
    return rows.select("page", "color_ratio", "text_ratio", "gray_ratio", C.page_type(F.col("blob_colour"), F.col("blob_content_gray"), F.col("text_ratio")).alias("type"))


@query("coarse_route", f"WITH {MASK_SQL} SELECT page, CASE WHEN text_ratio < 0.005 THEN 'image' ELSE 'text' END AS route, text_ratio >= 0 AND color_ratio < 0.005 AND NOT colour_any AND NOT gray_any AS binarisable FROM ft")
def coarse_route(spark, sf_dir):
    agg = _masks(spark, sf_dir).groupBy("page").agg(P.share("text").alias("t"), P.share("colour").alias("c"), F.bool_or("colour").alias("a"), F.bool_or("content_gray").alias("g"))
    return agg.select("page", C.coarse_type(F.col("t")).alias("route"), ((F.col("c") < 0.005) & ~F.col("a") & ~F.col("g")).alias("binarisable"))


@query("route_union", f"WITH {MASK_SQL} SELECT page, CASE WHEN text_ratio < 0.005 THEN 'image-model' ELSE 'text-model' END AS backend FROM ft")
def route_union(spark, sf_dir):
    routed = _masks(spark, sf_dir).groupBy("page").agg(C.coarse_type(P.share("text")).alias("route"))
    both = [routed.where(F.col("route") == r).select("page", F.lit(f"{r}-model").alias("backend")) for r in ("text", "image")]
    return both[0].unionByName(both[1])


@query("dilate7", f"WITH {GRAY_SQL}, s AS (SELECT *, (gray < 100)::INT AS m FROM px), {_frame('m', 'max', 3, 's', 'd')} SELECT page, y, x, d_o AS near FROM d")
def dilate7(spark, sf_dir):
    df = N.by_page(gray_pixels(spark, sf_dir)).withColumn("m", P.ink().cast("int"))
    return N.dilate(df, "m", 3, "near").select("page", "y", "x", "near")


@query("erode3", f"WITH {GRAY_SQL}, s AS (SELECT *, (gray < 128)::INT AS m FROM px), {_frame('m', 'min', 1, 's', 'd')} SELECT page, y, x, d_o AS core FROM d")
def erode3(spark, sf_dir):
    df = N.by_page(gray_pixels(spark, sf_dir)).withColumn("m", (F.col("gray") < 128).cast("int"))
    return N.erode(df, "m", 1, "core").select("page", "y", "x", "core")


@query("morph_gradient", f"WITH {GRAY_SQL}, {_frame('gray', 'max', 1, 'px', 'a')}, {_frame('gray', 'min', 1, 'a', 'z')} SELECT page, y, x, a_o - z_o AS gradient FROM z")
def morph_gradient(spark, sf_dir):
    return N.gradient(N.by_page(gray_pixels(spark, sf_dir)), "gray", "gradient").select("page", "y", "x", "gradient")


def _taps(value: str, weights: list[int], axis: str) -> str:
    part, order = ("page, y", "x") if axis == "x" else ("page, x", "y")
    over = f"OVER (PARTITION BY {part} ORDER BY {order})"
    k = len(weights) // 2
    at = lambda d: "coalesce(" + ", ".join([*(f"{'lag' if d < 0 else 'lead'}({value}, {i}) {over}" for i in range(abs(d), 0, -1)), value]) + ")"
    return " + ".join(f"({w}) * {at(d)}" for d, w in zip(range(-k, k + 1), weights) if w)


GAUSS = [1, 4, 6, 4, 1]


@query("gauss5_text_mask", f"WITH {GRAY_SQL}, {_frame('gray', 'max', 1, 'px', 'a')}, {_frame('gray', 'min', 1, 'a', 'z')}, d AS (SELECT page, y, x, a_o - z_o AS v FROM z), h AS (SELECT *, {_taps('v', GAUSS, 'x')} AS s FROM d) SELECT page, y, x, ({_taps('s', GAUSS, 'y')}) > 40 * 256 AS text FROM h")
def gauss5_text_mask(spark, sf_dir):
    df = N.gradient(N.by_page(gray_pixels(spark, sf_dir)), "gray", "v")
    return N.separable(df, "v", GAUSS, GAUSS, "s").select("page", "y", "x", (F.col("s") > 40 * 256).alias("text"))


@query("otsu_threshold", f"""WITH {GRAY_SQL}, h AS (SELECT page, gray AS level, count(*) AS n FROM px GROUP BY ALL),
c AS (SELECT page, level, sum(n) OVER w AS n0, sum(level * n) OVER w AS m0, sum(n) OVER (PARTITION BY page) AS n1, sum(level * n) OVER (PARTITION BY page) AS m1 FROM h WINDOW w AS (PARTITION BY page ORDER BY level ROWS UNBOUNDED PRECEDING)),
v AS (SELECT page, level, CASE WHEN n0 = n1 THEN 0 ELSE pow(m1::DOUBLE * n0::DOUBLE - m0::DOUBLE * n1::DOUBLE, 2) / (n0::DOUBLE * (n1::DOUBLE - n0::DOUBLE)) END AS var FROM c)
SELECT page, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY var DESC, level) AS k FROM v) WHERE k = 1""")
def otsu_threshold(spark, sf_dir):
    return N.otsu(gray_pixels(spark, sf_dir))


CC_SQL = f"WITH RECURSIVE {GRAY_SQL}, {_cc('gray < 128', 'px')}"
AREAS_SQL = ", ar AS (SELECT page, label, count(*) AS area FROM lab GROUP BY ALL)"


def _gray_labels(spark, sf_dir) -> DataFrame:
    return CC.labels(gray_pixels(spark, sf_dir).withColumn("m", F.col("gray") < 128), "m", SIDE, SIDE, SIDE)


@query("cc_labels", f"{CC_SQL} SELECT * FROM lab")
def cc_labels(spark, sf_dir):
    """Labels merged over tiles of 3 x 3 pixels."""
    return CC.labels(gray_pixels(spark, sf_dir).withColumn("m", F.col("gray") < 128), "m", SIDE, SIDE, 3)


@query("cc_stats", f'{CC_SQL} SELECT page, label, count(*) AS area, min(x) AS "left", min(y) AS top, (max(x) - min(x) + 1)::INTEGER AS w, (max(y) - min(y) + 1)::INTEGER AS h FROM lab GROUP BY page, label')
def cc_stats(spark, sf_dir):
    return CC.stats(_gray_labels(spark, sf_dir))


@query("cc_largest_ratio", f"{CC_SQL}{AREAS_SQL} SELECT p.page, coalesce(max(area), 0) / 64.0::DOUBLE AS ratio FROM (SELECT DISTINCT page FROM px) p LEFT JOIN ar ON ar.page = p.page GROUP BY p.page")
def cc_largest_ratio(spark, sf_dir):
    return CC.largest_ratio(gray_pixels(spark, sf_dir).select("page").distinct(), _gray_labels(spark, sf_dir), AREA)


def kept(labelled: DataFrame, least: int) -> DataFrame:
    """The pixels of components of at least `least` pixels."""
    big = labelled.groupBy("page", "label").count().where(F.col("count") >= least).select("page", "label")
    return labelled.join(big, ["page", "label"], "left_semi")


@query("speck_filter", f"{CC_SQL}{AREAS_SQL} SELECT l.* FROM lab l SEMI JOIN (SELECT * FROM ar WHERE area >= 3) a ON a.page = l.page AND a.label = l.label")
def speck_filter(spark, sf_dir):
    return kept(_gray_labels(spark, sf_dir), 3).select("page", "y", "x", "label")


@query("large_blobs", f"{CC_SQL}{AREAS_SQL} SELECT page, label, area FROM ar WHERE area >= 0.25 * 64")
def large_blobs(spark, sf_dir):
    return _gray_labels(spark, sf_dir).groupBy("page", "label").agg(F.count("*").alias("area")).where(F.col("area") >= 0.25 * AREA)


@query("figure_subtract", f"""{CC_SQL}{AREAS_SQL}, fig AS (SELECT page, y, x FROM lab SEMI JOIN (SELECT * FROM ar WHERE area >= 16) a ON a.page = lab.page AND a.label = lab.label UNION SELECT page, y, x FROM px WHERE gray > 200)
SELECT page, y, x FROM px WHERE gray < 170 EXCEPT SELECT * FROM fig""")
def figure_subtract(spark, sf_dir):
    px = gray_pixels(spark, sf_dir)
    at = ["page", "y", "x"]
    figures = kept(_gray_labels(spark, sf_dir), 16).select(*at).union(px.where("gray > 200").select(*at)).distinct()
    return px.where("gray < 170").select(*at).join(figures, at, "left_anti")


# -- layered encoding -------------------------------------------------------------------------------------------------

MRC_SQL = f"""WITH RECURSIVE {BGR_SQL}, {_cc('gray < 170', 'col')},
fg AS (SELECT l.page, l.label, c.b, c.g, c.r, c.b + c.g + c.r AS lum FROM lab l JOIN col c ON c.page = l.page AND c.y = l.y AND c.x = l.x),
p30 AS (SELECT page, quantile_cont(lum::DOUBLE, 0.3) AS cut FROM fg GROUP BY page),
cc AS (SELECT fg.page, label, count(*) AS area,
  floor(coalesce(avg(b) FILTER (lum <= cut), avg(b)))::INTEGER AS b, floor(coalesce(avg(g) FILTER (lum <= cut), avg(g)))::INTEGER AS g, floor(coalesce(avg(r) FILTER (lum <= cut), avg(r)))::INTEGER AS r
  FROM fg JOIN p30 ON p30.page = fg.page GROUP BY fg.page, label),
hu AS (SELECT *, greatest(b, g, r) AS hi, greatest(b, g, r) - least(b, g, r) AS s FROM cc),
an AS (SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE WHEN hi = r THEN 60.0::DOUBLE * (g - b) / s WHEN hi = g THEN 120 + 60.0::DOUBLE * (b - r) / s ELSE 240 + 60.0::DOUBLE * (r - g) / s END AS ang FROM hu),
bk AS (SELECT page, label, area, b, g, r, s, CASE WHEN s <= 45 THEN -1 ELSE floor(floor(CASE WHEN ang < 0 THEN ang + 360 ELSE ang END / 2) / 30)::INTEGER END AS bucket FROM an),
gr AS (SELECT page, bucket, sum(area)::BIGINT AS area, min(label) AS first_label, sum(b * area)::BIGINT AS sb, sum(g * area)::BIGINT AS sg, sum(r * area)::BIGINT AS sr FROM bk GROUP BY page, bucket),
tk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY bucket <> -1, area DESC, first_label) AS rn FROM gr),
ch AS (SELECT * FROM tk WHERE bucket = -1 OR rn <= 3 + (SELECT count(*) FROM gr z WHERE z.page = tk.page AND z.bucket = -1))"""


def core_colours(spark, sf_dir) -> DataFrame:
    """Colour of each component: mean over its pixels among the darkest 30 % of the page's foreground, or over all of them."""
    px = bgr_pixels(spark, sf_dir).withColumn("gray", P.luma()).withColumn("m", F.col("gray") < P.DARK)
    fg = CC.labels(px, "m", SIDE, SIDE, SIDE).join(px, ["page", "y", "x"]).withColumn("lum", F.col("b") + F.col("g") + F.col("r"))
    fg = fg.withColumn("cut", F.percentile("lum", F.lit(0.3)).over(W.partitionBy("page")))
    mean = lambda c: F.floor(F.coalesce(F.avg(F.when(F.col("lum") <= F.col("cut"), F.col(c))), F.avg(c))).cast("int").alias(c)
    return fg.groupBy("page", "label").agg(F.count("*").alias("area"), *[mean(c) for c in "bgr"])


def colour_groups(core: DataFrame, colours: int = 3) -> DataFrame:
    """Black and the `colours` largest hue buckets of each page, with the area-weighted sums of their colours."""
    bucket = F.when(P.spread() <= 45, -1).otherwise(P.div(P.hue(), 30))
    groups = core.withColumn("bucket", bucket).groupBy("page", "bucket").agg(F.sum("area").alias("area"), F.min("label").alias("first_label"), *[F.sum(F.col(c) * F.col("area")).alias(f"s{c}") for c in "bgr"])
    is_colour = F.col("bucket") != -1
    rank = F.row_number().over(W.partitionBy("page", is_colour).orderBy(F.desc("area"), "first_label"))
    return groups.withColumn("rn", rank).where(~is_colour | (F.col("rn") <= colours))


@query("core_color", f"{MRC_SQL} SELECT page, label, area, b, g, r FROM cc")
def core_color(spark, sf_dir):
    return core_colours(spark, sf_dir)


@query("color_bucket_topk", f"{MRC_SQL} SELECT page, bucket, area, first_label FROM ch")
def color_bucket_topk(spark, sf_dir):
    return colour_groups(core_colours(spark, sf_dir)).select("page", "bucket", "area", "first_label")


@query("fill_color", f"""{MRC_SQL}, f AS (SELECT page, bucket, round_even(sb / greatest(area, 1), 0)::INTEGER AS b, round_even(sg / greatest(area, 1), 0)::INTEGER AS g, round_even(sr / greatest(area, 1), 0)::INTEGER AS r FROM ch)
SELECT page, bucket, CASE WHEN k THEN 0 ELSE b END AS b, CASE WHEN k THEN 0 ELSE g END AS g, CASE WHEN k THEN 0 ELSE r END AS r FROM (SELECT *, greatest(b, g, r) - least(b, g, r) <= 45 AS k FROM f)""")
def fill_color(spark, sf_dir):
    groups = colour_groups(core_colours(spark, sf_dir))
    fill = groups.select("page", "bucket", *[F.bround(F.col(f"s{c}") / F.greatest("area", F.lit(1)), 0).cast("int").alias(c) for c in "bgr"])
    black = P.spread() <= 45
    return fill.select("page", "bucket", *[F.when(black, 0).otherwise(F.col(c)).alias(c) for c in "bgr"])


@query("paint_cap", f"WITH {GRAY_SQL} SELECT page, floor(least(greatest(median(gray) + 70, 140), 190))::INTEGER AS cap FROM px WHERE gray < 170 GROUP BY page")
def paint_cap(spark, sf_dir):
    return gray_pixels(spark, sf_dir).where(F.col("gray") < P.DARK).groupBy("page").agg(F.floor(F.least(F.greatest(F.median("gray") + 70, F.lit(140.0)), F.lit(190.0))).cast("int").alias("cap"))


@query("coverage_gate", f"WITH {GRAY_SQL} SELECT page, avg((gray < 60)::INT::DOUBLE) AS coverage, avg((gray < 60)::INT::DOUBLE) >= 0.0005 AS layered FROM px GROUP BY page")
def coverage_gate(spark, sf_dir):
    c = P.share(F.col("gray") < 60)
    return gray_pixels(spark, sf_dir).groupBy("page").agg(c.alias("coverage"), (c >= 0.0005).alias("layered"))


@query("whiten", f"WITH {GRAY_SQL} SELECT page, y, x, CASE WHEN gray < 128 THEN 255 ELSE gray END AS gray FROM px")
def whiten(spark, sf_dir):
    return gray_pixels(spark, sf_dir).withColumn("gray", F.when(F.col("gray") < 128, 255).otherwise(F.col("gray")))


PACK_SQL = f"WITH {GRAY_SQL}, pk AS (SELECT page, y, x // 8 AS col, sum(CASE WHEN gray < 128 THEN 0 ELSE 1 << (7 - x % 8) END)::INTEGER AS byte FROM px GROUP BY page, y, x // 8)"


def packed(px: DataFrame) -> DataFrame:
    """Bytes of 8 pixels each, ink 0, leftmost pixel in the high bit."""
    bit = F.when(F.col("gray") < 128, 0).otherwise(F.expr("shiftleft(1, 7 - x % 8)"))
    return px.groupBy("page", "y", P.div(F.col("x"), 8).alias("col")).agg(F.sum(bit).cast("int").alias("byte"))


@query("bit_pack", f"{PACK_SQL} SELECT page, y, col::INTEGER AS col, byte FROM pk")
def bit_pack(spark, sf_dir):
    return packed(gray_pixels(spark, sf_dir))


@query("bit_unpack", f"{PACK_SQL} SELECT page, y, (col * 8 + i)::INTEGER AS x, (byte >> (7 - i)) & 1 = 0 AS ink FROM pk, (SELECT unnest(range(8))::INTEGER AS i)")
def bit_unpack(spark, sf_dir):
    rows = packed(gray_pixels(spark, sf_dir)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return rows.select("page", "y", (F.col("col") * 8 + F.col("i")).alias("x"), (F.expr("shiftright(byte, 7 - i) & 1") == 0).alias("ink"))


@query("area_downsample", f"WITH {GRAY_SQL} SELECT page, y // 2 AS y, x // 2 AS x, floor(sum(gray) / count(*))::INTEGER AS gray FROM px GROUP BY page, y // 2, x // 2")
def area_downsample(spark, sf_dir):
    return N.shrink(gray_pixels(spark, sf_dir), "gray", 2, "gray")


@query("nearest_upsample", f"WITH {GRAY_SQL}, d AS (SELECT unnest([0, 1])::INTEGER AS d) SELECT page, y * 2 + a.d AS y, x * 2 + b.d AS x, gray FROM px, d a, d b")
def nearest_upsample(spark, sf_dir):
    return N.enlarge(gray_pixels(spark, sf_dir), "gray", 2, "gray")


@query("crop_rect", f"WITH {GRAY_SQL} SELECT page, y - 2 AS y, x - 3 AS x, gray FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 3 AND 6")
def crop_rect(spark, sf_dir):
    return gray_pixels(spark, sf_dir).where(F.col("y").between(2, 5) & F.col("x").between(3, 6)).select("page", (F.col("y") - 2).alias("y"), (F.col("x") - 3).alias("x"), "gray")


# -- tiles ------------------------------------------------------------------------------------------------------------


def _origins_sql(size: str, tile: int, overlap: int) -> str:
    return f"list_distinct(list_append(range(0, greatest({size} - {tile}, 0) + 1, {tile - overlap}), greatest({size} - {tile}, 0)::BIGINT))"


@query("tile_grid", f"SELECT p_partkey AS page, unnest({_origins_sql('(p_size * 50 + 100)', 512, 32)})::INTEGER AS ty, tx::INTEGER AS tx FROM (SELECT *, unnest({_origins_sql('(p_size * 30 + 400)', 512, 32)}) AS tx FROM part)")
def tile_grid(spark, sf_dir):
    size = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size") * 50 + 100).alias("h"), (F.col("p_size") * 30 + 400).alias("w"))
    rows = size.select("page", "w", F.explode(N.origins(F.col("h"), 512, 32)).alias("ty"))
    return rows.select("page", "ty", F.explode(N.origins(F.col("w"), 512, 32)).alias("tx"))


_W = "least({0} - {1} + 1, {1} + 5 - {0})"


@query("feather_blend", f"""WITH {GRAY_SQL}, o AS (SELECT unnest([0, 3])::INTEGER AS o), t AS (
SELECT page, y, x, gray + 10 * a.o + b.o AS v, {_W.format('y', 'a.o')} * {_W.format('x', 'b.o')} AS w FROM px, o a, o b WHERE y - a.o BETWEEN 0 AND 4 AND x - b.o BETWEEN 0 AND 4)
SELECT page, y, x, sum(v * w)::DOUBLE / greatest(sum(w)::DOUBLE, 1e-8) AS v FROM t GROUP BY page, y, x""")
def feather_blend(spark, sf_dir):
    o = N.origins(F.lit(SIDE), 5, 2)
    t = gray_pixels(spark, sf_dir).withColumn("ty", F.explode(o)).withColumn("tx", F.explode(o)).where((F.col("y") - F.col("ty")).between(0, 4) & (F.col("x") - F.col("tx")).between(0, 4))
    weight = lambda p, q: F.least(F.col(p) - F.col(q) + 1, F.col(q) + 5 - F.col(p))
    t = t.withColumn("w", weight("y", "ty") * weight("x", "tx")).withColumn("v", F.col("gray") + 10 * F.col("ty") + F.col("tx"))
    return t.groupBy("page", "y", "x").agg((F.sum(F.col("v") * F.col("w")).cast("double") / F.greatest(F.sum("w").cast("double"), F.lit(1e-8))).alias("v"))


# -- comparisons ------------------------------------------------------------------------------------------------------

PAIR_SQL = f"{GRAY_SQL}, pr AS (SELECT a.page, a.y, a.x, a.gray AS p, b.gray AS q FROM px a JOIN px b ON b.page = a.page + 1 AND b.y = a.y AND b.x = a.x)"


def pairs(spark, sf_dir) -> DataFrame:
    """Each page (p) with the next one (q), pixel by pixel."""
    px = gray_pixels(spark, sf_dir)
    other = px.select((F.col("page") - 1).alias("page"), "y", "x", F.col("gray").alias("q"))
    return px.withColumnRenamed("gray", "p").join(other, ["page", "y", "x"])


@query("psnr_ssim", f"""WITH {PAIR_SQL}, s AS (SELECT page, count(*)::DOUBLE AS n, sum(p)::DOUBLE AS a, sum(q)::DOUBLE AS b, sum(p * p)::DOUBLE AS aa, sum(q * q)::DOUBLE AS bb, sum(p * q)::DOUBLE AS ab, sum((p - q) * (p - q))::DOUBLE AS e FROM pr GROUP BY page),
m AS (SELECT page, e / n AS mse, a / n AS ma, b / n AS mb, aa / n - (a / n) * (a / n) AS va, bb / n - (b / n) * (b / n) AS vb, ab / n - (a / n) * (b / n) AS c FROM s)
SELECT page, CASE WHEN mse = 0 THEN NULL ELSE round(10 * log10(65025.0::DOUBLE / mse), 6) END AS psnr, round((2 * ma * mb + 6.5025::DOUBLE) * (2 * c + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE)), 6) AS ssim FROM m""")
def psnr_ssim(spark, sf_dir):
    """Null PSNR where pages are equal; SSIM over the page as one window."""
    p, q = F.col("p"), F.col("q")
    d = lambda c: F.sum(c).cast("double")
    s = pairs(spark, sf_dir).groupBy("page").agg(F.count("*").cast("double").alias("n"), d(p).alias("a"), d(q).alias("b"), d(p * p).alias("aa"), d(q * q).alias("bb"), d(p * q).alias("ab"), d((p - q) * (p - q)).alias("e"))
    s = s.selectExpr("page", "e / n AS mse", "a / n AS ma", "b / n AS mb", "aa / n - (a / n) * (a / n) AS va", "bb / n - (b / n) * (b / n) AS vb", "ab / n - (a / n) * (b / n) AS c")
    return s.selectExpr("page", "CASE WHEN mse = 0 THEN NULL ELSE round(10 * log10(65025D / mse), 6) END AS psnr", "round((2 * ma * mb + 6.5025D) * (2 * c + 58.5225D) / ((ma * ma + mb * mb + 6.5025D) * (va + vb + 58.5225D)), 6) AS ssim")


@query("ink_missing_added", f"WITH {PAIR_SQL} SELECT page, avg((p < 128)::INT::DOUBLE) AS coverage, avg((p < 128 AND q >= 128)::INT::DOUBLE) AS missing, avg((q < 128 AND p >= 128)::INT::DOUBLE) AS added FROM pr GROUP BY page")
def ink_missing_added(spark, sf_dir):
    src, new = F.col("p") < 128, F.col("q") < 128
    return pairs(spark, sf_dir).groupBy("page").agg(P.share(src).alias("coverage"), P.share(src & ~new).alias("missing"), P.share(new & ~src).alias("added"))


@query("ink_diffmap", f"""WITH {GRAY_SQL}, a AS (SELECT page, y, x FROM px WHERE gray < 128), b AS (SELECT page - 1 AS page, y, x FROM px WHERE gray < 128)
SELECT coalesce(a.page, b.page) AS page, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, CASE WHEN b.page IS NULL THEN 'reference' WHEN a.page IS NULL THEN 'candidate' ELSE 'both' END AS side FROM a FULL JOIN b ON a.page = b.page AND a.y = b.y AND a.x = b.x""")
def ink_diffmap(spark, sf_dir):
    on = gray_pixels(spark, sf_dir).where("gray < 128")
    a = on.select("page", "y", "x", F.lit(1).alias("a"))
    b = on.select((F.col("page") - 1).alias("page"), "y", "x", F.lit(1).alias("b"))
    side = F.when(F.col("b").isNull(), "reference").when(F.col("a").isNull(), "candidate").otherwise("both")
    return a.join(b, ["page", "y", "x"], "full").select("page", "y", "x", side.alias("side"))


@query("component_survival", f"""WITH RECURSIVE {GRAY_SQL}, {_cc('gray < 128', 'px')}, k AS (SELECT l.page, l.label, count(*) AS area, avg((n.gray < 128)::INT::DOUBLE) AS keep FROM lab l JOIN px n ON n.page = l.page + 1 AND n.y = l.y AND n.x = l.x GROUP BY l.page, l.label HAVING count(*) >= 3)
SELECT page, count(*) AS components, count(*) FILTER (keep < 0.5) AS lost FROM k GROUP BY page""")
def component_survival(spark, sf_dir):
    new = gray_pixels(spark, sf_dir).select((F.col("page") - 1).alias("page"), "y", "x", (F.col("gray") < 128).alias("on"))
    k = _gray_labels(spark, sf_dir).join(new, ["page", "y", "x"]).groupBy("page", "label").agg(F.count("*").alias("area"), P.share("on").alias("keep")).where("area >= 3")
    return k.groupBy("page").agg(F.count("*").alias("components"), F.count_if(F.col("keep") < 0.5).alias("lost"))


@query("minmax_normalise", f"WITH {GRAY_SQL} SELECT page, y, x, CASE WHEN hi = lo THEN 0 ELSE 255 - (gray - lo) * 255 // (hi - lo) END AS v FROM (SELECT *, max(gray) OVER (PARTITION BY page) AS hi, min(gray) OVER (PARTITION BY page) AS lo FROM px)")
def minmax_normalise(spark, sf_dir):
    w = W.partitionBy("page")
    px = gray_pixels(spark, sf_dir).withColumn("hi", F.max("gray").over(w)).withColumn("lo", F.min("gray").over(w))
    v = F.when(F.col("hi") == F.col("lo"), 0).otherwise(255 - P.div((F.col("gray") - F.col("lo")) * 255, F.col("hi") - F.col("lo")))
    return px.select("page", "y", "x", v.alias("v"))


SMOOTH, SLOPE = [1, 2, 1], [-1, 0, 1]


@query("sobel_blend", f"""WITH {GRAY_SQL}, a AS (SELECT *, {_taps('gray', SLOPE, 'x')} AS sx, {_taps('gray', SMOOTH, 'x')} AS sy FROM px), b AS (SELECT page, y, x, {_taps('sx', SMOOTH, 'y')} AS gx, {_taps('sy', SLOPE, 'y')} AS gy FROM a)
SELECT page, y, x, floor((least(abs(gx), 255) + least(abs(gy), 255)) / 2)::INTEGER AS edge FROM b""")
def sobel_blend(spark, sf_dir):
    df = N.by_page(gray_pixels(spark, sf_dir))
    df = N.separable(N.separable(df, "gray", SLOPE, SMOOTH, "gx"), "gray", SMOOTH, SLOPE, "gy")
    side = lambda c: F.least(F.abs(F.col(c)), F.lit(255))
    return df.select("page", "y", "x", F.floor((side("gx") + side("gy")) / 2).cast("int").alias("edge"))


@query("ratio_apply", f"WITH {GRAY_SQL}, b AS (SELECT *, max(gray) OVER (PARTITION BY page) AS top FROM px) SELECT page, y, x, least(floor(gray * 255.0::DOUBLE / CASE WHEN top = 0 THEN 1 ELSE top END), 255)::INTEGER AS v FROM b")
def ratio_apply(spark, sf_dir):
    top = F.max("gray").over(W.partitionBy("page"))
    return gray_pixels(spark, sf_dir).select("page", "y", "x", F.least(F.floor(F.col("gray") * 255.0 / F.when(top == 0, 1).otherwise(top)), F.lit(255)).cast("int").alias("v"))


@query("blob_profile", f"""WITH RECURSIVE {GRAY_SQL}, {_cc('gray < 128', 'px')}, paper AS (SELECT page, quantile_cont(gray::DOUBLE, 0.9) AS p90 FROM px GROUP BY page),
s AS (SELECT l.page, l.label, count(*) AS area, sum(gray)::DOUBLE AS s1, sum(gray * gray)::DOUBLE AS s2, bool_or(l.x IN (0, 7) OR l.y IN (0, 7)) AS border FROM lab l JOIN px p ON p.page = l.page AND p.y = l.y AND p.x = l.x GROUP BY l.page, l.label),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, label)::INTEGER AS rank FROM s)
SELECT r.page, rank, area, s1 / area AS mean, round(sqrt(greatest(s2 / area - (s1 / area) * (s1 / area), 0)), 6) AS std, p90 - s1 / area AS darkness, border FROM r JOIN paper ON paper.page = r.page WHERE rank <= 3""")
def blob_profile(spark, sf_dir):
    px = gray_pixels(spark, sf_dir)
    paper = px.groupBy("page").agg(F.percentile("gray", F.lit(0.9)).alias("p90"))
    edge = F.col("x").isin(0, SIDE - 1) | F.col("y").isin(0, SIDE - 1)
    s = _gray_labels(spark, sf_dir).join(px, ["page", "y", "x"]).groupBy("page", "label").agg(F.count("*").alias("area"), F.sum("gray").cast("double").alias("s1"), F.sum(F.col("gray") * F.col("gray")).cast("double").alias("s2"), F.bool_or(edge).alias("border"))
    r = s.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy(F.desc("area"), "label"))).where("rank <= 3").join(paper, "page")
    mean = F.col("s1") / F.col("area")
    std = F.round(F.sqrt(F.greatest(F.col("s2") / F.col("area") - mean * mean, F.lit(0.0))), 6)
    return r.select("page", "rank", "area", mean.alias("mean"), std.alias("std"), (F.col("p90") - mean).alias("darkness"), "border")


@query("bit_layer_diff", f"""{PACK_SQL} SELECT a.page, sum(bit_count(xor(a.byte, b.byte)))::BIGINT AS bits, bool_and(a.byte = b.byte) AS equal FROM pk a JOIN pk b ON b.page = a.page + 1 AND b.y = a.y AND b.col = a.col GROUP BY a.page""")
def bit_layer_diff(spark, sf_dir):
    a = packed(gray_pixels(spark, sf_dir))
    b = a.select((F.col("page") - 1).alias("page"), "y", "col", F.col("byte").alias("other"))
    return a.join(b, ["page", "y", "col"]).groupBy("page").agg(F.sum(F.bit_count(F.col("byte").bitwiseXOR(F.col("other")))).alias("bits"), F.bool_and(F.col("byte") == F.col("other")).alias("equal"))
