"""Queries over job logs, configuration and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fixtures import LOG_SQL, log_rows, table
from .registry import query

_L = f"WITH {LOG_SQL} "
#: Progress of a job: where each stage begins and how much of the whole it takes (fixed values).
OCR, PAGE, REBUILD = (0.03, 0.22), (0.30, 0.55), 0.90


def stage(line: Column) -> Column:
    return F.when(line.startswith("plan"), "planning").when(line.startswith("OCR"), "ocr").when(line.startswith("page"), "enhancing").when(line.contains("rebuild"), "rebuilding").when(line.startswith("total"), "done")


def progress(line: Column) -> Column:
    """Share of the job that a log line stands for; null for lines without one."""
    k, n = F.regexp_extract(line, r"(\d+)/(\d+)", 1).try_cast("double"), F.regexp_extract(line, r"(\d+)/(\d+)", 2).try_cast("double")
    f = k / F.greatest(n, F.lit(1.0))
    return F.when(line.startswith("OCR"), OCR[0] + OCR[1] * f).when(line.startswith("page"), PAGE[0] + PAGE[1] * f).when(line.contains("rebuild"), REBUILD).when(line.startswith("total"), 1.0)


_STAGE = "CASE WHEN line LIKE 'plan%' THEN 'planning' WHEN line LIKE 'OCR%' THEN 'ocr' WHEN line LIKE 'page%' THEN 'enhancing' WHEN line LIKE '%rebuild%' THEN 'rebuilding' WHEN line LIKE 'total%' THEN 'done' END"
_FRAC = "regexp_extract(line, '(\\d+)/(\\d+)', 1)::DOUBLE / greatest(regexp_extract(line, '(\\d+)/(\\d+)', 2)::DOUBLE, 1)"
_PROGRESS = f"CASE WHEN line LIKE 'OCR%' THEN 0.03::DOUBLE + 0.22::DOUBLE * ({_FRAC}) WHEN line LIKE 'page%' THEN 0.3::DOUBLE + 0.55::DOUBLE * ({_FRAC}) WHEN line LIKE '%rebuild%' THEN 0.9::DOUBLE WHEN line LIKE 'total%' THEN 1.0::DOUBLE END"


@query("log_progress", _L + f"SELECT job, seq, {_STAGE} AS stage, coalesce(max({_PROGRESS}) OVER (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS progress FROM lg")
def log_progress(spark, sf_dir):
    """Progress after each line: it never falls."""
    so_far = W.partitionBy("job").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return log_rows(spark, sf_dir).select("job", "seq", stage(F.col("line")).alias("stage"), F.coalesce(F.max(progress(F.col("line"))).over(so_far), F.lit(0.0)).alias("progress"))


@query("stage_last", _L + f"SELECT job, arg_max({_STAGE}, seq) AS stage, count(*) AS lines FROM lg GROUP BY job")
def stage_last(spark, sf_dir):
    return log_rows(spark, sf_dir).groupBy("job").agg(F.max_by(stage(F.col("line")), "seq").alias("stage"), F.count("*").alias("lines"))


@query("log_after", _L + "SELECT job, seq, line FROM lg WHERE seq > 3")
def log_after(spark, sf_dir):
    """Lines after the first three of each job, by absolute number."""
    return log_rows(spark, sf_dir).where("seq > 3").select("job", "seq", "line")


@query("log_ring", _L + "SELECT job, seq, line FROM (SELECT *, max(seq) OVER (PARTITION BY job) AS n FROM lg) WHERE seq > n - 5")
def log_ring(spark, sf_dir):
    """The last five lines of each job."""
    return log_rows(spark, sf_dir).withColumn("n", F.max("seq").over(W.partitionBy("job"))).where("seq > n - 5").select("job", "seq", "line")


#: Events as steps of a job's life (fixed values).
STATES = {"signup": "queued", "view": "running", "click": "running", "purchase": "done", "error": "error"}
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"


@query("job_states", _L + f"SELECT job, arg_max({_STATE}, seq) AS status, count(*) FILTER ({_STATE} = 'running') AS steps FROM lg GROUP BY job")
def job_states(spark, sf_dir):
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event_type")]
    return log_rows(spark, sf_dir).groupBy("job").agg(F.max_by(state, "seq").alias("status"), F.count_if(state == "running").alias("steps"))


@query("job_fifo", _L + f", s AS (SELECT job, arg_max({_STATE}, seq) AS status, min(event_id) AS created FROM lg GROUP BY job) SELECT job, created FROM s WHERE status = 'queued' ORDER BY created LIMIT 1")
def job_fifo(spark, sf_dir):
    """The queued job that was created first."""
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event_type")]
    s = log_rows(spark, sf_dir).groupBy("job").agg(F.max_by(state, "seq").alias("status"), F.min("event_id").alias("created"))
    return s.where("status = 'queued'").orderBy("created").limit(1).select("job", "created")


_JSON = "'{\"dpi\": ' || c_nationkey * 10 || ', \"name\": \"' || c_name || '\", \"segment\": \"' || c_mktsegment || '\", \"version\": 2}'"


@query("signature", f"SELECT c_custkey, substr(sha1({_JSON}), 1, 12) AS signature FROM customer")
def signature(spark, sf_dir):
    """First 12 hex digits of the SHA-1 of the settings as JSON with sorted keys."""
    text = F.format_string('{"dpi": %s, "name": "%s", "segment": "%s", "version": 2}', (F.col("c_nationkey") * 10).cast("string"), "c_name", "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha1(text), 1, 12).alias("signature"))


#: A stage's defaults, and keys that aren't its parameters (fixed values).
DEFAULTS = {"scale": "2", "tile": "384", "task": "appearance"}
NOT_PARAMETERS = ["backend", "enabled", "weights", "routing"]


@query("config_merge", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE '2' END AS scale, CASE WHEN n_regionkey <> 0 THEN n_regionkey::VARCHAR ELSE '384' END AS tile, 'appearance' AS task, 3::INTEGER AS n_keys FROM nation")
def config_merge(spark, sf_dir):
    """Defaults under a stage's own keys; keys with empty values, and those that aren't parameters, don't count."""
    key = F.col("n_nationkey")
    own = F.create_map(F.lit("scale"), F.when(key % 2 == 0, key.cast("string")).otherwise(""), F.lit("tile"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey").cast("string")).otherwise(""), F.lit("backend"), F.col("n_name"))
    own = F.map_filter(own, lambda k, v: (v != "") & ~k.isin(NOT_PARAMETERS))
    defaults = F.map_filter(F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv]), lambda k, v: ~F.array_contains(F.map_keys(F.col("own")), k))
    merged = table(spark, sf_dir, "nation").select(key.alias("id"), own.alias("own")).select("id", F.map_concat("own", defaults).alias("m"))
    return merged.select("id", *[F.col("m")[k].alias(k) for k in DEFAULTS], F.size("m").alias("n_keys"))


@query("dpi_param", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey::INTEGER END AS dpi FROM customer")
def dpi_param(spark, sf_dir):
    """A digit string is a number, a blank is auto (null)."""
    raw = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(raw.rlike(r"^\d+$"), raw.try_cast("int")).alias("dpi"))


@query("stage_backend", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'none' ELSE n_name END AS backend FROM nation")
def stage_backend(spark, sf_dir):
    """A disabled stage has the backend none."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "none").otherwise(F.col("n_name")).alias("backend"))
