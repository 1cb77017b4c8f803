"""Queries over page metadata, checkpoints and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import classify as C
from .fixtures import PAGES_SQL, page_rows, table
from .registry import query

_P = f"WITH {PAGES_SQL} "


@query("page_range_prune", _P + ", n AS (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM pg) SELECT book, page FROM n WHERE page - 1 BETWEEN greatest(0, book % 5 - 1) AND least(n - 1, book % 7)")
def page_range_prune(spark, sf_dir):
    """Pages (from 0) within a range clamped to the book; a reversed range is empty."""
    n = F.count("*").over(W.partitionBy("book"))
    pages = page_rows(spark, sf_dir).select("book", "page", n.alias("n"))
    return pages.where((F.col("page") - 1).between(F.greatest(F.lit(0), F.col("book") % 5 - 1), F.least(F.col("n") - 1, F.col("book") % 7))).select("book", "page")


@query("range_clamp", _P + "SELECT book, count(*) AS n, least(book % 5, count(*) - 1) AS first_page, greatest(least(book % 5, count(*) - 1), least(coalesce(nullif(book % 3, 0), count(*) - 1), count(*) - 1)) AS last_page FROM pg GROUP BY book")
def range_clamp(spark, sf_dir):
    """A range clamped so that it is never empty; a missing end is the last page."""
    b = page_rows(spark, sf_dir).groupBy("book").agg(F.count("*").alias("n"))
    last = F.col("n") - 1
    first = F.least(F.col("book") % 5, last)
    end = F.least(F.coalesce(F.nullif(F.col("book") % 3, F.lit(0)), last), last)
    return b.select("book", "n", first.alias("first_page"), F.greatest(first, end).alias("last_page"))


def page_range(text: Column) -> tuple[Column, Column]:
    """First and last page (from 0) of `N` (the first N) or `a-b` (from 1, both included); nulls if it is neither."""
    a, b = F.regexp_extract(text, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*\d+\s*-\s*(\d+)\s*$", 1).try_cast("int")
    n = F.regexp_extract(text, r"^\s*(\d+)\s*$", 1).try_cast("int")
    return F.when(n.isNotNull(), F.lit(0)).otherwise(a - 1), F.when(n.isNotNull(), n - 1).otherwise(b - 1)


_ARG = "CASE n_nationkey % 3 WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_regionkey || '-' || n_nationkey ELSE n_name END"


@query("page_range_parse", f"""WITH a AS (SELECT n_nationkey AS id, {_ARG} AS arg FROM nation), x AS (SELECT *, regexp_matches(arg, '^\\d+$') AS one, regexp_matches(arg, '^\\d+-\\d+$') AS two FROM a)
SELECT id, CASE WHEN one THEN 0 WHEN two THEN split_part(arg, '-', 1)::INTEGER - 1 END AS first_page, CASE WHEN one THEN arg::INTEGER - 1 WHEN two THEN split_part(arg, '-', 2)::INTEGER - 1 END AS last_page FROM x""")
def page_range_parse(spark, sf_dir):
    key = F.col("n_nationkey")
    arg = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(F.col("n_regionkey").cast("string"), F.lit("-"), key.cast("string"))).otherwise(F.col("n_name"))
    first, last = page_range(F.col("arg"))
    return table(spark, sf_dir, "nation").select(key.alias("id"), arg.alias("arg")).select("id", first.alias("first_page"), last.alias("last_page"))


def dpi_choice(nominal: Column, most: int) -> Column:
    """Render resolution for a nominal one: 300 where there is none, else within 72..most."""
    return F.when(nominal <= 0, 300).otherwise(F.floor(F.least(F.greatest(nominal, F.lit(72.0)), F.lit(float(most))))).cast("int")


_DPI = _P + ", d AS (SELECT book, page, coalesce(max(px_w * 72.0::DOUBLE / w) FILTER (w > 0 AND px_w > 0), 0) AS nominal FROM (SELECT *, (jpeg_bytes % 7) * 100 AS w FROM pg) GROUP BY book, page), c AS (SELECT *, CASE WHEN nominal <= 0 THEN 300 ELSE floor(least(greatest(nominal, 72), 400))::INTEGER END AS dpi FROM d) "


def _nominal(spark, sf_dir) -> DataFrame:
    px = page_rows(spark, sf_dir).withColumn("w", (F.col("jpeg_bytes") % 7) * 100)
    nominal = F.coalesce(F.max(F.when((F.col("w") > 0) & (F.col("px_w") > 0), F.col("px_w") * 72.0 / F.col("w"))), F.lit(0.0))
    return px.groupBy("book", "page").agg(nominal.alias("nominal")).withColumn("dpi", dpi_choice(F.col("nominal"), 400))


@query("nominal_dpi", _DPI + "SELECT book, page, nominal, dpi FROM c")
def nominal_dpi(spark, sf_dir):
    return _nominal(spark, sf_dir)


@query("dpi_histogram", _DPI + "SELECT dpi, count(*) AS pages FROM c GROUP BY dpi")
def dpi_histogram(spark, sf_dir):
    return _nominal(spark, sf_dir).groupBy("dpi").agg(F.count("*").alias("pages"))


@query("dual_encode_choice", _P + "SELECT book, page, CASE WHEN bg_bytes + stencil_bytes < jpeg_bytes THEN 'mrc' ELSE 'jpeg' END AS kind, least(bg_bytes + stencil_bytes, jpeg_bytes) AS bytes FROM pg")
def dual_encode_choice(spark, sf_dir):
    """The smaller of both encodings; a tie is JPEG."""
    layered = F.col("bg_bytes") + F.col("stencil_bytes")
    return page_rows(spark, sf_dir).select("book", "page", F.when(layered < F.col("jpeg_bytes"), "mrc").otherwise("jpeg").alias("kind"), F.least(layered, "jpeg_bytes").alias("bytes"))


_CENSUS = "SELECT CASE WHEN bg_bytes + stencil_bytes < jpeg_bytes THEN 'mrc' ELSE 'jpeg' END AS kind, least(bg_bytes + stencil_bytes, jpeg_bytes) AS bytes, book, page, ptype FROM pg"


@query("encoding_census", _P + f"SELECT kind, count(*) AS pages, sum(bytes)::BIGINT AS bytes, sum(bytes)::DOUBLE / (sum(sum(bytes)) OVER ())::DOUBLE AS share FROM ({_CENSUS}) GROUP BY kind")
def encoding_census(spark, sf_dir):
    by = dual_encode_choice(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"))
    return by.withColumn("share", F.col("bytes").cast("double") / F.sum("bytes").over(W.partitionBy()).cast("double"))  # a row for each kind


@query("encoding_rollup", _P + f"SELECT ptype, kind, count(*) AS pages, sum(bytes)::BIGINT AS bytes FROM ({_CENSUS}) GROUP BY ROLLUP (ptype, kind)")
def encoding_rollup(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    layered = F.col("bg_bytes") + F.col("stencil_bytes")
    rows = rows.select("ptype", F.when(layered < F.col("jpeg_bytes"), "mrc").otherwise("jpeg").alias("kind"), F.least(layered, "jpeg_bytes").alias("bytes"))
    return rows.rollup("ptype", "kind").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"))


@query("heaviest_pages", _P + "SELECT book, page, jpeg_bytes FROM pg ORDER BY jpeg_bytes DESC, page DESC, book DESC LIMIT 15")
def heaviest_pages(spark, sf_dir):
    return page_rows(spark, sf_dir).select("book", "page", "jpeg_bytes").orderBy(F.desc("jpeg_bytes"), F.desc("page"), F.desc("book")).limit(15)


@query("mean_page_size", _P + "SELECT book, sum(jpeg_bytes)::DOUBLE / greatest(1, count(*)) / 1048576.0::DOUBLE AS mb_per_page, max(px_w) AS widest FROM pg GROUP BY book")
def mean_page_size(spark, sf_dir):
    mean = F.sum("jpeg_bytes").cast("double") / F.greatest(F.lit(1), F.count("*")) / 1048576.0
    return page_rows(spark, sf_dir).groupBy("book").agg(mean.alias("mb_per_page"), F.max("px_w").alias("widest"))


def encoding_class(kinds: dict[str, Column]) -> Column:
    """Class of a page by which image filters occur on it."""
    one, jpeg, flate = kinds["one_bit"], kinds["jpeg"], kinds["flate"]
    return F.when(one & jpeg, "MRC").when(one, "1-bit").when(jpeg, "JPEG").when(flate, "Flate").otherwise("vector")


@query("encoding_set", _P + """, f AS (SELECT book, bool_or(ptype = 'bw-text') AS one, bool_or(ptype IN ('mixed', 'color-image')) AS jp, bool_or(ptype = 'gray-text') AS fl FROM pg GROUP BY book)
SELECT book, CASE WHEN one AND jp THEN 'MRC' WHEN one THEN '1-bit' WHEN jp THEN 'JPEG' WHEN fl THEN 'Flate' ELSE 'vector' END AS class FROM f""")
def encoding_set(spark, sf_dir):
    t = F.col("ptype")
    any_of = lambda *k: F.bool_or(t.isin(*k))
    return page_rows(spark, sf_dir).groupBy("book").agg(encoding_class({"one_bit": any_of("bw-text"), "jpeg": any_of("mixed", "color-image"), "flate": any_of("gray-text")}).alias("class"))


@query("mrc_plane_params", _P + "SELECT book, page, CASE WHEN page % 2 = 0 THEN 2 ELSE 3 END AS scale, CASE WHEN page % 3 = 0 THEN 7 WHEN ptype = 'gray-text' THEN 5 ELSE 0 END AS denoise, least(60 + page * 10, 85) AS quality FROM pg")
def mrc_plane_params(spark, sf_dir):
    p = F.col("page")
    scale, noise = F.when(p % 2 == 0, "auto").otherwise("3"), F.when(p % 3 == 0, "7").otherwise("auto")
    return page_rows(spark, sf_dir).select("book", "page", C.plane_scale(scale).alias("scale"), C.plane_denoise(noise, F.col("ptype")).alias("denoise"), F.least(60 + p * 10, F.lit(85)).alias("quality"))


# -- checkpoints ------------------------------------------------------------------------------------------------------

DONE_SQL = ", done AS (SELECT book, page, ptype, px_w FROM pg WHERE page % 3 <> 0)"


def checkpoint(spark, sf_dir) -> DataFrame:
    return page_rows(spark, sf_dir).where("page % 3 <> 0").select("book", "page", "ptype", "px_w")


@query("resume_antijoin", _P + DONE_SQL + " SELECT book, page FROM pg ANTI JOIN done USING (book, page)")
def resume_antijoin(spark, sf_dir):
    return page_rows(spark, sf_dir).select("book", "page").join(checkpoint(spark, sf_dir), ["book", "page"], "left_anti")


@query("rebuild_missing", _P + DONE_SQL + ", m AS (SELECT book, page FROM pg ANTI JOIN done USING (book, page)) SELECT book, count(*) AS missing, string_agg(page, ',' ORDER BY page) FILTER (k <= 10) AS first_pages, greatest(count(*) - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) AS k FROM m) GROUP BY book")
def rebuild_missing(spark, sf_dir):
    """Missing pages of each book: how many, the first ten, how many more."""
    k = F.row_number().over(W.partitionBy("book").orderBy("page"))
    m = resume_antijoin(spark, sf_dir).withColumn("k", k)
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.col("page")))), ",")
    return m.groupBy("book").agg(F.count("*").alias("missing"), first.alias("first_pages"), F.greatest(F.count("*") - 10, F.lit(0)).alias("more"))


@query("cached_merge", _P + DONE_SQL + " SELECT pg.book, pg.page, coalesce(done.ptype, 'new') AS ptype, done.page IS NOT NULL AS cached FROM pg LEFT JOIN done ON done.book = pg.book AND done.page = pg.page")
def cached_merge(spark, sf_dir):
    done = checkpoint(spark, sf_dir).select("book", "page", "ptype", F.lit(True).alias("hit"))
    return page_rows(spark, sf_dir).select("book", "page").join(done, ["book", "page"], "left").select("book", "page", F.coalesce("ptype", F.lit("new")).alias("ptype"), F.coalesce("hit", F.lit(False)).alias("cached"))


@query("store_stats", _P + DONE_SQL + " SELECT book, count(*) AS pages, sum(px_w)::BIGINT AS bytes FROM done GROUP BY book")
def store_stats(spark, sf_dir):
    return checkpoint(spark, sf_dir).groupBy("book").agg(F.count("*").alias("pages"), F.sum("px_w").alias("bytes"))


@query("compare_pairs", _P + ", o AS (SELECT book, page + 2 AS page, px_w FROM pg) SELECT pg.book, pg.page, pg.px_w AS px_enhanced, o.px_w AS px_original FROM pg JOIN o ON o.book = pg.book AND o.page = pg.page + 1")
def compare_pairs(spark, sf_dir):
    """Page k of an enhanced range beside page start + k - 1 of the original (start 2)."""
    pages = page_rows(spark, sf_dir)
    original = pages.select("book", (F.col("page") + 1).alias("page"), F.col("px_w").alias("px_original"))
    return pages.join(original, ["book", "page"]).select("book", "page", F.col("px_w").alias("px_enhanced"), "px_original")


# -- layers of two files ----------------------------------------------------------------------------------------------

AB_SQL = """, a AS (SELECT book, page, px_w, px_h, jpeg_bytes, row_number() OVER (PARTITION BY book ORDER BY px_w, px_h, jpeg_bytes, page) AS rn FROM pg),
b0 AS (SELECT book, page, px_w, px_h + CASE WHEN page % 5 = 0 THEN 100 ELSE 0 END AS px_h, jpeg_bytes FROM pg WHERE page % 7 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY px_w, px_h, jpeg_bytes, page) AS rn FROM b0)"""


@query("layer_ab_compare", _P + AB_SQL + " SELECT coalesce(a.book, b.book) AS book, coalesce(a.rn, b.rn)::INTEGER AS layer, CASE WHEN b.book IS NULL THEN 'missing' WHEN a.book IS NULL THEN 'extra' WHEN a.px_w = b.px_w AND a.px_h = b.px_h AND a.jpeg_bytes = b.jpeg_bytes THEN 'equal' ELSE 'differs' END AS verdict FROM a FULL JOIN b ON a.book = b.book AND a.rn = b.rn")
def layer_ab_compare(spark, sf_dir):
    """Layers of two files, matched by rank of size within their book."""
    pages = page_rows(spark, sf_dir).select("book", "page", "px_w", "px_h", "jpeg_bytes")
    ranked = lambda df: df.withColumn("layer", F.row_number().over(W.partitionBy("book").orderBy("px_w", "px_h", "jpeg_bytes", "page"))).select("book", "layer", F.struct("px_w", "px_h", "jpeg_bytes").alias("key"))
    other = pages.where("page % 7 <> 0").withColumn("px_h", F.col("px_h") + F.when(F.col("page") % 5 == 0, 100).otherwise(0))
    both = ranked(pages).withColumnRenamed("key", "a").join(ranked(other).withColumnRenamed("key", "b"), ["book", "layer"], "full")
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "equal").otherwise("differs")
    return both.select("book", "layer", verdict.alias("verdict"))


_PAINT = "CASE WHEN page % 2 = 0 THEN 1 - px_w / 2300.0::DOUBLE ELSE px_w / 2300.0::DOUBLE END"


@query("ink_extremes", _P + f", i AS (SELECT book, page, {_PAINT} AS ink FROM pg) SELECT book, min(ink) AS least_ink, arg_min(page, (ink, page)) AS least_page, max(ink) AS most_ink, count(*) FILTER (ink > 0.9) AS black FROM i GROUP BY book")
def ink_extremes(spark, sf_dir):
    """Painted share of stencils by book; the polarity of a stencil's decode array flips it."""
    painted = F.when(F.col("page") % 2 == 0, 1 - F.col("px_w") / 2300.0).otherwise(F.col("px_w") / 2300.0)
    rows = page_rows(spark, sf_dir).select("book", "page", painted.alias("ink"))
    return rows.groupBy("book").agg(F.min("ink").alias("least_ink"), F.min_by("page", F.struct("ink", "page")).alias("least_page"), F.max("ink").alias("most_ink"), F.count_if(F.col("ink") > 0.9).alias("black"))


@query("filter_census", _P + ", b AS (SELECT book, page, CASE WHEN page % 5 = 0 THEN 'gray-image' ELSE ptype END AS ptype FROM pg WHERE page % 7 <> 0) SELECT a.ptype AS filter_a, b.ptype AS filter_b, count(*) AS pages FROM pg a JOIN b ON a.book = b.book AND b.page = a.page GROUP BY a.ptype, b.ptype")
def filter_census(spark, sf_dir):
    """Pairs of encodings of the same page in two files, the second with other encodings and without some pages."""
    pages = page_rows(spark, sf_dir).select("book", "page", F.col("ptype").alias("filter_a"))
    other = pages.where("page % 7 <> 0").select("book", "page", F.when(F.col("page") % 5 == 0, "gray-image").otherwise(F.col("filter_a")).alias("filter_b"))
    return pages.join(other, ["book", "page"]).groupBy("filter_a", "filter_b").agg(F.count("*").alias("pages"))


@query("black_page_probe", _P + f" SELECT book, bool_or({_PAINT} > 0.95) AS rebuild FROM pg GROUP BY book")
def black_page_probe(spark, sf_dir):
    ink = F.when(F.col("page") % 2 == 0, 1 - F.col("px_w") / 2300.0).otherwise(F.col("px_w") / 2300.0)
    return page_rows(spark, sf_dir).groupBy("book").agg(F.bool_or(ink > 0.95).alias("rebuild"))


# -- names ------------------------------------------------------------------------------------------------------------


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, from KB on with one decimal, halves rounded up."""
    unit = lambda size, name: F.format_string(f"%.1f {name}", F.floor(n / float(size) * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, "KB")).when(n < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))


@query("human_size", _P + ", s AS (SELECT book, sum(stencil_bytes)::BIGINT AS n FROM pg GROUP BY book UNION ALL SELECT -book, min(px_w)::BIGINT AS n FROM pg GROUP BY book) SELECT book, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(n / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM s")
def human_sizes(spark, sf_dir):
    pages = page_rows(spark, sf_dir)
    big, small = pages.groupBy("book").agg(F.sum("stencil_bytes").alias("n")), pages.groupBy("book").agg(F.min("px_w").cast("long").alias("n"))
    return big.unionByName(small.withColumn("book", -F.col("book"))).select("book", "n", human_size(F.col("n")).alias("size"))


@query("output_names", _P + "SELECT book, page, 'book' || book || CASE WHEN page > 1 THEN '_p1-' || page ELSE '' END || '_enhanced.pdf' AS file, 'p' || lpad(page::VARCHAR, 5, '0') AS page_name FROM pg")
def output_names(spark, sf_dir):
    part = F.when(F.col("page") > 1, F.concat(F.lit("_p1-"), F.col("page").cast("string"))).otherwise("")
    return page_rows(spark, sf_dir).select("book", "page", F.concat(F.lit("book"), F.col("book").cast("string"), part, F.lit("_enhanced.pdf")).alias("file"), F.concat(F.lit("p"), F.lpad(F.col("page").cast("string"), 5, "0")).alias("page_name"))


@query("fill_operator", _P + "SELECT DISTINCT px_w, printf('%.4f %.4f %.4f rg', (px_w % 256) / 255.0::DOUBLE, (px_w // 2 % 256) / 255.0::DOUBLE, (px_w // 3 % 256) / 255.0::DOUBLE) AS op FROM pg")
def fill_operator(spark, sf_dir):
    """Paint operator of a colour kept as b, g, r, written as r, g, b."""
    w = page_rows(spark, sf_dir).select("px_w").distinct()
    part = lambda k: F.floor(F.col("px_w") / k) % 256 / 255.0
    return w.select("px_w", F.format_string("%.4f %.4f %.4f rg", part(1), part(2), part(3)).alias("op"))
