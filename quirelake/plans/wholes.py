"""Queries over whole tables: sums over rectangles, ranks, passages within texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import needles, sums
from ..operators.ranks import ranked
from ..streaming.jobs import not_stopped
from .fixtures import MOSAIC, MOSAIC_SQL, mosaic_pixels, table
from .registry import query

_R, _NEW = 12, 12


def _gray(spark, sf_dir):
    return mosaic_pixels(spark, sf_dir).select("page", "y", "x", P.luma().alias("gray"))


@query("box_mean_ink", f"""WITH {MOSAIC_SQL}, a AS (SELECT page, y, x, gray, sum(gray) OVER w AS s, count(*) OVER w AS c FROM mc WINDOW w AS (PARTITION BY page, y ORDER BY x RANGE BETWEEN {_R} PRECEDING AND {_R} FOLLOWING)),
b AS (SELECT page, y, x, gray, sum(s) OVER w AS s, sum(c) OVER w AS n FROM a WINDOW w AS (PARTITION BY page, x ORDER BY y RANGE BETWEEN {_R} PRECEDING AND {_R} FOLLOWING))
SELECT page, y, x, (gray * n <= s - 10 * n)::INTEGER AS ink FROM b""")
def box_mean_ink(spark, sf_dir):
    """Ink against the mean of 25 x 25, from a summed-area table."""
    return sums.mean_ink(_gray(spark, sf_dir), _R, 10)


@query("area_resize", f"""WITH {MOSAIC_SQL}, o AS (SELECT i, s, least((i + 1) * {MOSAIC}, (s + 1) * {_NEW}) - greatest(i * {MOSAIC}, s * {_NEW}) AS w FROM (SELECT unnest(range({_NEW}))::INTEGER AS i), (SELECT unnest(range({MOSAIC}))::INTEGER AS s)),
r AS (SELECT a.i AS y, b.i AS x, m.page, sum(a.w * b.w * m.gray)::BIGINT AS t FROM mc m JOIN o a ON a.s = m.y AND a.w > 0 JOIN o b ON b.s = m.x AND b.w > 0 GROUP BY ALL)
SELECT page, y, x, ((2 * t + {MOSAIC * MOSAIC}) // {2 * MOSAIC * MOSAIC})::INTEGER AS gray FROM r""")
def area_resize(spark, sf_dir):
    """Pages of 32 x 32 as 12 x 12, each pixel the mean of the area it covers."""
    return sums.area_resized(_gray(spark, sf_dir), "gray", MOSAIC, _NEW)


@query("queue_positions", "SELECT job, created, row_number() OVER (ORDER BY created, job) - 1 AS position FROM (SELECT user_id AS job, min(event_id) AS created FROM events GROUP BY user_id)")
def queue_positions(spark, sf_dir):
    """Place of each job in one queue over all jobs, by its first event."""
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.min("event_id").alias("created"))
    return ranked(jobs, "created", "job", name="position")


@query("sheet_places", "SELECT doc_id, k // 24 AS sheet, (k % 24 // 6)::INTEGER AS row, (k % 6)::INTEGER AS col FROM (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS k FROM documents)")
def sheet_places(spark, sf_dir):
    """Sheet, row and column of each document on contact sheets of four rows of six, longest documents first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n"))
    k = F.col("k")
    return ranked(docs, F.desc("n"), F.asc("doc_id"), name="k").select("doc_id", F.floor(k / 24).alias("sheet"), F.floor(k % 24 / 6).cast("int").alias("row"), (k % 6).cast("int").alias("col"))


@query("needle_hits", """SELECT doc_id, item_id, instr(d.text, b.text)::INTEGER AS first_at, ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::BIGINT AS hits
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def needle_hits(spark, sf_dir):
    """Where the passages of benchmark stand in documents."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return needles.hits(texts, passages).groupBy("doc_id", "item_id").agg(F.min("at").cast("int").alias("first_at"), F.count("*").alias("hits"))


@query("pages_not_stopped", """WITH e AS (SELECT event_id, user_id AS job, ts, event_type FROM events), s AS (SELECT job, ts FROM e WHERE event_type = 'error')
SELECT job, event_id FROM e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM s WHERE s.job = e.job AND s.ts <= e.ts AND s.ts >= e.ts - INTERVAL 2 DAY)""")
def pages_not_stopped(spark, sf_dir):
    """Pages (clicks) of jobs (users) without a stop (an error) in the two days up to them; streams of both give the same."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job"), F.col("ts").alias("time"), "event_type")
    pages = ev.where("event_type = 'click'").drop("event_type")
    return not_stopped(pages, ev.where("event_type = 'error'").select("job", "time"), 2 * 24 * 3600).select("job", "event_id")
