"""Pages made from the driver's tables, as FIXTURES.md defines them, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one 8 x 8 page for each vector."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("pos", "e"))
    gray = F.floor(F.least(F.greatest((F.col("e").cast("double") + 0.5) * 256, F.lit(0.0)), F.lit(255.0))).cast("int")
    return px.select("page", F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).alias("x"), gray.alias("gray"))


#: Tone maps of F2 by page % 6: condition on gray, then (b, g, r) if it holds and if not.
TONES = [("gray < 88", (20, 20, 20), (245, 245, 245)), ("gray < 128", (130, 130, 130), (245, 245, 245)), ("gray < 128", (150, 150, 150), (170, 170, 170)), ("gray < 100", (20, 20, 220), (245, 245, 245)), ("true", (60, 70, 80), (60, 70, 80)), ("gray < 128", (40, 120, 200), (200, 200, 200))]


def _tone(i: int) -> str:
    return "CASE page % 6 " + " ".join(f"WHEN {k} THEN CASE WHEN {c} THEN {a[i]} ELSE {b[i]} END" for k, (c, a, b) in enumerate(TONES)) + " END"


def bgr_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the pages of F1 through one of six tone maps."""
    return gray_pixels(spark, sf_dir).select("page", "y", "x", *[F.expr(_tone(i)).alias(c) for i, c in enumerate("bgr")])


GRAY_SQL = """px AS (SELECT vec_id AS page, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x, floor(least(greatest((e::DOUBLE + 0.5) * 256, 0), 255))::INTEGER AS gray
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
BGR_SQL = GRAY_SQL + f""", bgr AS (SELECT page, y, x, {_tone(0)} AS b, {_tone(1)} AS g, {_tone(2)} AS r FROM px),
col AS (SELECT *, (114 * b + 587 * g + 299 * r) // 1000 AS gray, greatest(b, g, r) AS hi, greatest(b, g, r) - least(b, g, r) AS spread FROM bgr)"""

_PAGE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the pages of books, from lineitem."""
    # The number comes first, so that what is worked out from a line isn't shuffled with it.
    li = table(spark, sf_dir, "lineitem").withColumn("page", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_PAGE_ORDER)).cast("int"))
    cents = lambda c, k: F.floor(F.col(c) * k).cast("long")
    kind = F.concat("l_returnflag", "l_linestatus")
    return li.select(
        F.col("l_orderkey").alias("book"), "page", cents("l_extendedprice", 100).alias("jpeg_bytes"),
        (cents("l_extendedprice", 50) + 1000 * cents("l_discount", 1000)).alias("bg_bytes"), (1000 * cents("l_quantity", 100)).alias("stencil_bytes"),
        F.when(kind == "AF", "bw-text").when(kind == "RF", "gray-text").when(kind == "NF", "mixed").when(kind == "NO", "color-image").otherwise("gray-image").alias("ptype"),
        (F.floor("l_quantity").cast("int") * 40 + 200).alias("px_w"), (F.floor(F.col("l_tax") * 100).cast("int") * 100 + 300).alias("px_h"),
    )


PAGES_SQL = """pg AS (SELECT l_orderkey AS book, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate))::INTEGER AS page,
  floor(l_extendedprice * 100)::BIGINT AS jpeg_bytes, floor(l_extendedprice * 50)::BIGINT + 1000 * floor(l_discount * 1000)::BIGINT AS bg_bytes, 1000 * floor(l_quantity * 100)::BIGINT AS stencil_bytes,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'bw-text' WHEN 'RF' THEN 'gray-text' WHEN 'NF' THEN 'mixed' WHEN 'NO' THEN 'color-image' ELSE 'gray-image' END AS ptype,
  floor(l_quantity)::INTEGER * 40 + 200 AS px_w, floor(l_tax * 100)::INTEGER * 100 + 300 AS px_h FROM lineitem)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the lines of documents as text spans."""
    doc = table(spark, sf_dir, "documents")
    line = doc.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    return line.select("page", "ln", "text", (12 * F.col("ln")).alias("y0"), (12 * F.col("ln") + 12).alias("y1"), (6 * F.length("text")).alias("x1"))


SPANS_SQL = """sp AS (SELECT doc_id AS page, (i - 1)::INTEGER AS ln, t AS text, (12 * (i - 1))::INTEGER AS y0, (12 * (i - 1) + 12)::INTEGER AS y1, (6 * length(t))::INTEGER AS x1
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a log line for each event; a job is a user."""
    ev = table(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("int")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("plan: pages "), k))
        .when(F.col("event_type") == "view", F.concat(F.lit("OCR "), k, F.lit("/100")))
        .when(F.col("event_type") == "click", F.concat(F.lit("page "), k, F.lit("/100 done")))
        .when(F.col("event_type") == "purchase", F.lit("rebuild pdf"))
        .otherwise(F.lit("total time"))
    )
    return ev.select(F.col("user_id").alias("job"), seq.alias("seq"), "event_id", "event_type", line.alias("line"))


LOG_SQL = """lg AS (SELECT user_id AS job, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS seq, event_id, event_type,
  CASE event_type WHEN 'signup' THEN 'plan: pages ' || k WHEN 'view' THEN 'OCR ' || k || '/100' WHEN 'click' THEN 'page ' || k || '/100 done' WHEN 'purchase' THEN 'rebuild pdf' ELSE 'total time' END AS line
  FROM (SELECT *, coalesce(json_extract_string(props, '$.k'), '0') AS k FROM events))"""


#: Side of the mosaic pages of F3.
MOSAIC = 32


def _stroke(i: int) -> str:
    """F3's channel i: tone maps, but two pages of eight are coloured with two dots or with lines of text, which makes them color-text and mixed."""
    paper = (40, 120, 200)[i]
    return f"CASE WHEN page % 8 = 5 THEN CASE WHEN y = x AND y % 10 = 5 AND y > 9 THEN 20 ELSE {paper} END WHEN page % 8 = 6 THEN CASE WHEN y % 8 = 3 AND x BETWEEN 3 AND 28 THEN 20 ELSE {paper} END ELSE {_tone(i)} END"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gray_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, y and the places (xs) and grays of each line of F3, from 16 vectors that meet in one exchange as they are; what comes of a page stays in its partition."""
    vec = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) > 0")
    gray = F.transform("embedding", lambda e: F.floor(F.least(F.greatest((e.cast("double") + 0.5) * 256, F.lit(0.0)), F.lit(255.0))).cast("short"))
    # A vector is a tile of 8 x 8; what a longer one has beyond lies in the tiles below.
    part = F.explode(F.sequence(F.lit(0), F.floor((F.size("gray") - 1) / SIDE**2).cast("int"))).alias("k")
    vec = vec.select("vec_id", gray.alias("gray")).select("vec_id", "gray", part).where("k < 4")
    tile = (F.pmod("vec_id", F.lit(16)) + 4 * F.col("k")).cast("int").alias("tile")
    vec = vec.select(F.floor(F.col("vec_id") / 16).alias("page"), tile, F.slice("gray", F.col("k") * SIDE**2 + 1, F.lit(SIDE**2)).alias("grays")).where("tile < 16")
    pages = vec.groupBy("page").agg(F.collect_list(F.struct("tile", "grays")).alias("parts"))

    def at(own: Column, y: Column, x: Column) -> Column:
        # Of vectors of one id each has its pixel; a place without any is white.
        values = F.array_compact(F.transform(own, lambda g: F.get(g, y % SIDE * SIDE + x % SIDE).cast("int")))
        return F.transform(F.when(F.size(values) == 0, F.array(F.lit(255))).otherwise(values), lambda g: F.struct(x.alias("x"), g.alias("g")))

    places = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    line = lambda tiles, y: F.flatten(F.transform(places(MOSAIC), lambda x: at(F.get(tiles, (F.floor(y / SIDE) * 4 + F.floor(x / SIDE)).cast("int")), y, x)))
    tiles = F.transform(places(16), lambda t: F.transform(F.filter("parts", lambda p: p["tile"] == t), lambda p: p["grays"]))
    lines = _let(tiles, lambda of: F.transform(places(MOSAIC), lambda y: F.struct(y.alias("y"), line(of, y).alias("px"))))
    rows = pages.select("page", F.explode(lines).alias("l"))
    return rows.select("page", F.col("l")["y"].alias("y"), F.col("l")["px"]["x"].alias("xs"), F.col("l")["px"]["g"].alias("grays"))


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 pages of F1 as the tiles of one page of 32 x 32, through the tone map of that page; where a vector is missing the page is white."""
    rows = _gray_lines(spark, sf_dir).select("page", "y", F.explode(F.arrays_zip("xs", "grays")).alias("p")).select("page", "y", F.col("p")["xs"].alias("x"), F.col("p")["grays"].alias("gray"))
    return rows.select("page", "y", "x", *[F.expr(_stroke(i)).alias(c) for i, c in enumerate("bgr")])


def mosaic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3's luma line by line: page, y, and arrays of the places (xs) and grays of a line."""
    bgr = F.expr("zip_with(xs, grays, (x, gray) -> named_struct(" + ", ".join(f"'{c}', {_stroke(i)}" for i, c in enumerate("bgr")) + "))")
    return _gray_lines(spark, sf_dir).select("page", "y", "xs", F.transform(bgr, lambda p: P.div(114 * p["b"] + 587 * p["g"] + 299 * p["r"], 1000)).alias("grays"))


def mosaic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 as page rows (page, h, w, data)."""
    import pyarrow as pa

    def page(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("y", "ascending"), ("x", "ascending")])
        data = bytes(v for p in zip(*(rows.column(c).to_pylist() for c in "bgr")) for v in p)
        return pa.table({"page": rows.column("page")[:1], "h": pa.array([MOSAIC], pa.int32()), "w": pa.array([MOSAIC], pa.int32()), "data": pa.array([data], pa.binary())})

    return mosaic_pixels(spark, sf_dir).groupBy("page").applyInArrow(page, "page long, h int, w int, data binary")


MOSAIC_SQL = GRAY_SQL + f""", mz AS (SELECT page // 16 AS page, ((page % 16) // 4 * 8 + y)::INTEGER AS y, (page % 16 % 4 * 8 + x)::INTEGER AS x, gray FROM px),
mw AS (SELECT page, y, unnest(range(32))::INTEGER AS x FROM (SELECT page, unnest(range(32))::INTEGER AS y FROM (SELECT DISTINCT page FROM mz))),
mf AS (SELECT mw.page, mw.y, mw.x, coalesce(mz.gray, 255) AS gray FROM mw LEFT JOIN mz ON mz.page = mw.page AND mz.y = mw.y AND mz.x = mw.x),
mb AS (SELECT page, y, x, {_stroke(0)} AS b, {_stroke(1)} AS g, {_stroke(2)} AS r FROM mf),
mc AS (SELECT *, ((114 * b + 587 * g + 299 * r) // 1000)::INTEGER AS gray, greatest(b, g, r) AS hi, greatest(b, g, r) - least(b, g, r) AS spread FROM mb)"""
