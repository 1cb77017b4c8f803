"""Queries over text spans, recognised text and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fixtures import SPANS_SQL, spans, table
from .registry import query

_S = f"WITH {SPANS_SQL} "
#: Marks that don't count in recognised text (fixed values).
MARKS = "，。、；：？！（）()[]{},."


def normalised(text: Column) -> Column:
    """Text without white space and MARKS."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), MARKS, "")


def cer(got: Column, truth: Column) -> Column:
    """Character error rate, 1 at most; for an empty truth 1 if anything was read, else 0."""
    return F.when(F.length(truth) == 0, F.when(F.length(got) > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(got, truth) / F.length(truth)))


_NORM = f"translate(regexp_replace(text, '\\s+', '', 'g'), '{MARKS}', '')"


@query("text_normalise", f"SELECT conv_id, turn, {_NORM} AS text FROM conversations")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalised(F.col("text")).alias("text"))


#: Letters beyond ASCII that the SQL replaces by single bytes, as its engine's edit distance counts bytes and Spark's counts characters (fixed values; the bytes don't occur in normalised text).
LETTERS = "ÀÁÂÄÇÈÉÊËÍÎÑÓÔÖÚÜßàáâäçèéêëíîñóôöúûü"
_BYTES = "".join(chr(i) for i in [*range(1, 32), *map(ord, "()[]{}"), 127])[: len(LETTERS)]


def _bytes(text: str) -> str:
    return f"translate({text}, '{LETTERS}', '{_BYTES}')"


def _cer(got: str, truth: str) -> str:
    return f"CASE WHEN length({truth}) = 0 THEN CASE WHEN length({got}) > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0::DOUBLE, levenshtein({_bytes(got)}, {_bytes(truth)})::DOUBLE / length({truth})) END::DOUBLE"


@query("cer_pairs", f"""WITH c AS (SELECT conv_id, turn, {_NORM} AS t FROM conversations)
SELECT a.conv_id, a.turn, {_cer('a.t', 'b.t')} AS cer FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def cer_pairs(spark, sf_dir):
    """Error rate between neighbouring turns, whole texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", normalised(F.col("text")).alias("got"))
    truth = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("got").alias("truth"))
    return c.join(truth, ["conv_id", "turn"]).select("conv_id", "turn", cer(F.col("got"), F.col("truth")).alias("cer"))


@query("span_bbox", _S + "SELECT page, ln, 0.0::DOUBLE AS x0, y0 / 2.0::DOUBLE AS y0, x1 / 2.0::DOUBLE AS x1, y1 / 2.0::DOUBLE AS y1 FROM sp")
def span_bbox(spark, sf_dir):
    """Boxes of four corners in pixels to point rectangles (zoom 2)."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    zero, wide = F.lit(0), F.col("x1")
    rows = spans(spark, sf_dir).select("page", "ln", F.array(corner(zero, "y0"), corner(wide, "y0"), corner(wide, "y1"), corner(zero, "y1")).alias("box"))
    side = lambda fold, c: fold(F.transform("box", lambda p: p[c])) / 2.0
    return rows.select("page", "ln", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


@query("reading_order", _S + "SELECT page, string_agg(text, '' ORDER BY y0 + y1, x1, ln) AS text FROM sp GROUP BY page")
def reading_order(spark, sf_dir):
    """Spans of a page joined by mean y, then mean x."""
    return spans(spark, sf_dir).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("y0") + F.col("y1")).alias("cy"), "x1", "ln", "text"))), lambda s: s["text"]), "").alias("text"))


@query("ocr_stats", _S + "SELECT page, count(*) AS boxes, sum(length(text))::BIGINT AS chars, coalesce(avg((length(text) % 100) / 100.0::DOUBLE) FILTER (length(text) > 0), 0) AS confidence FROM sp GROUP BY page")
def ocr_stats(spark, sf_dir):
    score = F.when(F.length("text") > 0, F.length("text") % 100 / 100.0)
    return spans(spark, sf_dir).groupBy("page").agg(F.count("*").alias("boxes"), F.sum(F.length("text")).alias("chars"), F.coalesce(F.avg(score), F.lit(0.0)).alias("confidence"))


@query("font_size", _S + "SELECT page, ln, greatest(2, least(y1 - y0 + ln % 60 - 12, 60)) AS size, y1 AS baseline FROM sp")
def font_size(spark, sf_dir):
    """Size of hidden text, within 2..60, on the lower edge of its box."""
    return spans(spark, sf_dir).select("page", "ln", F.greatest(F.lit(2), F.least(F.col("y1") - F.col("y0") + F.col("ln") % 60 - 12, F.lit(60))).alias("size"), F.col("y1").alias("baseline"))


@query("search_needles", _S + ", h AS (SELECT page, ln, CASE WHEN contains(text, 'License') THEN 1 WHEN contains(text, 'the') THEN 2 END AS needle FROM sp) SELECT page, ln, needle FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY needle, ln) AS k FROM h WHERE needle IS NOT NULL) WHERE k = 1")
def search_needles(spark, sf_dir):
    """First line of each page that holds one of the needles, earlier needles first."""
    needle = F.when(F.contains("text", F.lit("License")), 1).when(F.contains("text", F.lit("the")), 2)
    hits = spans(spark, sf_dir).select("page", "ln", needle.alias("needle")).where("needle IS NOT NULL")
    best = F.min(F.struct("needle", "ln"))
    return hits.groupBy("page").agg(best.alias("b")).select("page", "b.ln", "b.needle")


@query("rect_overlap_join", _S + """, q AS (SELECT item_id, 40 * item_id AS qx0, 40 * item_id + 200 AS qx1, 12 * item_id AS qy0, 12 * item_id + 30 AS qy1 FROM benchmark)
SELECT q.item_id, count(*) AS hits FROM q JOIN sp ON sp.x1 > q.qx0 AND 0 < q.qx1 AND sp.y1 > q.qy0 AND sp.y0 < q.qy1 GROUP BY q.item_id""")
def rect_overlap_join(spark, sf_dir):
    """Spans that overlap each query rectangle: both sides are cut into bands of y, joined by band, and counted once in the first shared band."""
    band = 64
    cut = lambda c: F.floor(F.col(c) / band)
    at = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select("item_id", (40 * at).alias("qx0"), (40 * at + 200).alias("qx1"), (12 * at).alias("qy0"), (12 * at + 30).alias("qy1"))
    q = q.withColumn("band", F.explode(F.sequence(cut("qy0"), cut("qy1"))))
    s = spans(spark, sf_dir).select("y0", "y1", "x1").withColumn("band", F.explode(F.sequence(cut("y0"), cut("y1"))))
    once = F.col("band") == F.greatest(cut("y0"), cut("qy0"))
    hit = (F.col("x1") > F.col("qx0")) & (F.col("qx1") > 0) & (F.col("y1") > F.col("qy0")) & (F.col("y0") < F.col("qy1"))
    return q.join(s, "band").where(once & hit).groupBy("item_id").agg(F.count("*").alias("hits"))


@query("spans_attach", _S + ", n AS (SELECT page, count(*) AS spans FROM sp WHERE page % 3 = 0 GROUP BY page) SELECT d.doc_id AS page, n.spans FROM documents d LEFT JOIN n ON n.page = d.doc_id")
def spans_attach(spark, sf_dir):
    """Pages with their spans where a recognition was stored, null where none was."""
    n = spans(spark, sf_dir).where("page % 3 = 0").groupBy("page").agg(F.count("*").alias("spans"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page")).join(n, "page", "left")


@query("resize_rule", "SELECT doc_id, n_chars AS w, n_chars // 2 AS h, CASE WHEN n_chars <= 2000 THEN n_chars ELSE 2000 END AS new_w, CASE WHEN n_chars <= 2000 THEN n_chars // 2 ELSE floor((n_chars // 2) * (2000.0::DOUBLE / n_chars))::BIGINT END AS new_h FROM documents")
def resize_rule(spark, sf_dir):
    """Size for recognition: the long side is 2000 at most."""
    w = F.col("n_chars")
    h = F.floor(w / 2)
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w"), h.alias("h"), F.least(w, F.lit(2000)).alias("new_w"), F.when(w <= 2000, h).otherwise(F.floor(h * (F.lit(2000.0) / w))).alias("new_h"))


#: Configurations of a benchmark, by name and step of the turns they read (fixed values).
CONFIGS = [("none", 1), ("restore", 2), ("sr", 3), ("both", 4)]
_CONFIGS = "(VALUES " + ", ".join(f"('{n}', {k})" for n, k in CONFIGS) + ") AS c(config, step)"
_MATRIX = f"""WITH g AS (SELECT item_id AS page, {_NORM} AS truth FROM benchmark), m AS (SELECT config, step, page, truth, substr(truth, 1, greatest(length(truth) - 5 * step - (page % 4)::INTEGER, 0)) AS got FROM g, {_CONFIGS}),
d AS (SELECT config, page, {_cer('got', 'truth')} AS cer, page % 7 + step AS seconds FROM m) """


def benchmark_rows(spark, sf_dir) -> DataFrame:
    """Each configuration on each page with its error rate over the whole text; the configurations are a fixed handful, exploded into each page."""
    g = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), normalised(F.col("text")).alias("truth"))
    configs = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(k).alias("step")) for n, k in CONFIGS])
    m = g.withColumn("c", F.explode(configs)).select("page", "truth", "c.config", "c.step")
    cut = F.greatest(F.length("truth") - 5 * F.col("step") - (F.col("page") % 4).cast("int"), F.lit(0))
    return m.select("config", "page", cer(F.substring(F.col("truth"), F.lit(1), cut), F.col("truth")).alias("cer"), (F.col("page") % 7 + F.col("step")).alias("seconds"))


@query("benchmark_matrix", _MATRIX + "SELECT config, page, cer, seconds FROM d")
def benchmark_matrix(spark, sf_dir):
    return benchmark_rows(spark, sf_dir)


@query("benchmark_rollup", _MATRIX + "SELECT config, round(avg(cer), 9) AS avg_cer, sum(seconds)::BIGINT AS total_seconds, count(*) AS pages FROM d GROUP BY config")
def benchmark_rollup(spark, sf_dir):
    return benchmark_rows(spark, sf_dir).groupBy("config").agg(F.round(F.avg("cer"), 9).alias("avg_cer"), F.sum("seconds").alias("total_seconds"), F.count("*").alias("pages"))


@query("truth_lookup", "SELECT d.doc_id AS page, coalesce(b.text, '') AS truth FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def truth_lookup(spark, sf_dir):
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.col("text").alias("truth"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page")).join(truth, "page", "left").select("page", F.coalesce("truth", F.lit("")).alias("truth"))


@query("contact_sheet", "SELECT doc_id, (k // 6)::INTEGER AS sheet_row, (k % 6)::INTEGER AS sheet_col FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)")
def contact_sheet(spark, sf_dir):
    """Place on a sheet of six columns, in order within each source."""
    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k")).select("doc_id", F.floor(F.col("k") / 6).cast("int").alias("sheet_row"), (F.col("k") % 6).alias("sheet_col"))


@query("pixel_rect", _S + "SELECT page, ln, 0::INTEGER AS px0, trunc(y0 * 1.7::DOUBLE)::INTEGER AS py0, trunc(x1 * 1.7::DOUBLE)::INTEGER AS px1, trunc(y1 * 1.7::DOUBLE)::INTEGER AS py1 FROM sp")
def pixel_rect(spark, sf_dir):
    """Boxes in points as whole pixels at scale 1.7, cut off towards zero."""
    px = lambda c: (F.col(c) * 1.7).cast("int")
    return spans(spark, sf_dir).select("page", "ln", F.lit(0).alias("px0"), px("y0").alias("py0"), px("x1").alias("px1"), px("y1").alias("py1"))


@query("locate_first_hit", _S + ", h AS (SELECT page, ln, y0, contains(text, 'License') OR contains(text, 'license') AS hard FROM sp WHERE page % 10 BETWEEN 2 AND 6 AND contains(text, 'the') OR page % 10 BETWEEN 2 AND 6 AND (contains(text, 'License') OR contains(text, 'license'))) SELECT page // 10 AS book, arg_min(page, (NOT hard, page, ln)) AS page, arg_min(ln, (NOT hard, page, ln)) AS ln, bool_or(hard) AS hard FROM h GROUP BY page // 10")
def locate_first_hit(spark, sf_dir):
    """Within a slice of each book's pages, the first line with a sure keyword, or else the first with a weak one."""
    hard = F.contains("text", F.lit("License")) | F.contains("text", F.lit("license"))
    rows = spans(spark, sf_dir).where((F.col("page") % 10).between(2, 6)).select("page", "ln", hard.alias("hard"), F.contains("text", F.lit("the")).alias("weak")).where("hard OR weak")
    best = F.min(F.struct((~F.col("hard")).alias("soft"), "page", "ln")).alias("best")
    return rows.groupBy(F.floor(F.col("page") / 10).alias("book")).agg(best, F.bool_or("hard").alias("hard")).select("book", "best.page", "best.ln", "hard")


@query("filter_names", "SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'JPEG' WHEN 'de' THEN 'JBIG2' WHEN 'fr' THEN 'Flate' WHEN 'es' THEN 'G4' ELSE 'none' END AS name FROM documents")
def filter_names(spark, sf_dir):
    """Short names of stream filters by a literal map."""
    from ..sources.pdf import FILTERS

    code = {"en": "DCTDecode", "de": "JBIG2Decode", "fr": "FlateDecode", "es": "CCITTFaxDecode"}
    names = F.create_map(*[F.lit(x) for k, v in code.items() for x in (k, FILTERS[v])])
    return table(spark, sf_dir, "documents").select("lang").distinct().select("lang", F.coalesce(names[F.col("lang")], F.lit("none")).alias("name"))
