"""Streams of job logs and job requests: stage, progress and last lines of each job, the life of jobs, pages of jobs that weren't stopped, one serial consumer, and page checkpoints that can be resumed.

Lines may come late, repeated and in any order over batches. Stage is that of the line with the largest number that has one and progress the largest of all lines, so any line may take part in these at any time, however late; only the ring of the last RING lines lets lines go.
State is a value and up to RING lines a job, in a state store on disk: a batch reads and writes what it changes, not the ring. Steps of a job are put in order of their time, over batches, by event-time timers.

Streams with state of this kind need the RocksDB store: stateful() sets it for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.jobs import progress, stage

RING = 4000
_OUT = "job long, seq long, stage string, progress double, n_lines long"


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Follow(StatefulProcessor):
    """State: what is known of a job, and the lines of its ring by number."""

    def __init__(self, ring: int) -> None:
        self.ring = ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.about = handle.getValueState("about", "seq long, stage_seq long, stage string, progress double, held long")
        self.lines = handle.getMapState("lines", "seq long", "line string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, stage_seq, at, done, held = self.about.get() if self.about.exists() else (-1, -1, None, 0.0, 0)
        before = seq
        for x in rows:
            if x.stage is not None and x.seq > stage_seq:
                stage_seq, at = x.seq, x.stage
            if x.progress is not None:
                done = max(done, x.progress)
            if x.seq > seq - self.ring and not self.lines.containsKey((x.seq,)):
                self.lines.updateValue((x.seq,), (x.line,))
                held += 1
            seq = max(seq, x.seq)
        if seq > before >= 0 or held > self.ring:
            # What falls out of the ring is found by number where few numbers have passed, else by the lines themselves.
            gone = range(before - self.ring + 1, seq - self.ring + 1) if 0 <= before and seq - before <= self.ring else [k[0] for k in self.lines.keys() if k[0] <= seq - self.ring]
            for k in gone:
                if self.lines.containsKey((k,)):
                    self.lines.removeKey((k,))
                    held -= 1
        self.about.update((seq, stage_seq, at, float(done), held))
        yield Row(job=key[0], seq=seq, stage=at, progress=float(done), n_lines=held)

    def close(self) -> None:
        pass


def job_progress(log: DataFrame, ring: int = RING) -> DataFrame:
    """A row for each job with news in a batch of the stream log (job, seq, line): largest number, stage, progress, and lines in the ring."""
    stateful(log.sparkSession)
    rows = log.select(F.col("job").cast("long"), F.col("seq").cast("long"), "line", stage(F.col("line")).alias("stage"), progress(F.col("line")).alias("progress")).where("seq IS NOT NULL")
    return rows.groupBy("job").transformWithState(_Follow(ring), _OUT, "Update", "None")


def stored_near(batch: DataFrame, store: str) -> DataFrame:
    """sig and page of the stored pages that a batch may repeat. The batch's least and largest signature and page, a row that the driver sees, become filters that prune folders by signature and skip row groups by the pages in their footers, as files are sorted."""
    ends = batch.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("sig", "page") for f in (F.min, F.max)]).first()
    done = batch.sparkSession.read.schema(batch.schema).parquet(store).select("sig", "page")
    for c in ("sig", "page"):
        done = done.where(F.col(c).between(F.lit(ends[f"min_{c}"]), F.lit(ends[f"max_{c}"])))
    return done


def checkpoint_pages(pages: DataFrame, store: str, checkpoint: str):
    """Starts a query that adds pages (sig, page, ...) to the Parquet folder `store`, by signature and sorted, leaving out pages that are stored: restarting repeats none. A batch reads of the store what lies within its own range."""

    def keep(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["sig", "page"]).persist()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(store)
            new = batch
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                new = batch.join(stored_near(batch, store), ["sig", "page"], "left_anti").select(*batch.columns)
            new.repartitionByRange("sig", "page").sortWithinPartitions("sig", "page").write.mode("append").partitionBy("sig").parquet(store)
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What may follow each state of a job (fixed values).
NEXT = {None: {"draft", "queued"}, "draft": {"queued"}, "queued": {"running", "stopped"}, "running": {"done", "error", "stopped"}, "done": {"queued"}, "error": {"queued"}, "stopped": {"queued"}}


class _Live(StatefulProcessor):
    """State: the job's present state, and the steps that wait for their time to pass, by time; a timer a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "status string, created long, refused long")
        self.waiting = handle.getMapState("waiting", "at long", "statuses string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for x in rows:
            before = self.waiting.getValue((x.at,))[0].split(",") if self.waiting.containsKey((x.at,)) else []
            self.waiting.updateValue((x.at,), (",".join(sorted([*before, x.status])),))
            self.handle.registerTimer(x.at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey((at,)):
            return
        status, created, refused = self.about.get() if self.about.exists() else (None, None, 0)
        for step in self.waiting.getValue((at,))[0].split(","):
            if step in NEXT[status]:
                status, created = step, created if created is not None and status is not None else at
            else:
                refused += 1
        self.waiting.removeKey((at,))
        self.about.update((status, created, refused))
        yield Row(job=key[0], at=at, status=status, created=created, refused=refused)

    def close(self) -> None:
        pass


def job_states(requests: DataFrame, late: str = "10 seconds") -> DataFrame:
    """job, at (milliseconds), status, created and refused after each time at which a job of the stream requests (job, at, status) had steps: in order of time, once no earlier step can come any more but by more than `late`, which Spark drops.
    A step that can't follow the present state is refused; steps of one time go in order of their name."""
    stateful(requests.sparkSession)
    rows = requests.select(F.col("job").cast("long"), F.col("at").cast("long"), "status", F.timestamp_millis("at").alias("time")).where("at IS NOT NULL AND status IS NOT NULL").withWatermark("time", late)
    return rows.groupBy("job").transformWithState(_Live(), "job long, at long, status string, created long, refused long", "Append", "EventTime")


def not_stopped(pages: DataFrame, stops: DataFrame, within: int = 3600, late: str = "10 minutes") -> DataFrame:
    """The rows of pages (job, time, ...) whose job wasn't told to stop (stops: job, time) at their time or up to `within` seconds before it.

    As streams, an outer interval join: each page comes out once, when no stop for it can come any more. As tables, stops become their first and last time by job and stretch of `within` seconds, of which a page asks for its own and the one before: no page meets
    more than two rows, however often its job was stopped. Pages without a job or a time are never stopped."""
    if pages.isStreaming:
        p, s = pages.withWatermark("time", late), stops.select(F.col("job").alias("__job"), F.col("time").alias("__time")).withWatermark("__time", late)
        on = (F.col("job") == F.col("__job")) & (F.col("__time") <= F.col("time")) & (F.col("__time") >= F.col("time") - F.expr(f"INTERVAL {within} SECONDS"))
        return p.join(s, on, "left_outer").where("__job IS NULL").select(*pages.columns)
    micros, length = F.unix_micros(F.col("time").cast("timestamp")), within * 1_000_000
    stretch = F.floor(F.col("__t") / length)
    ends = stops.select("job", micros.alias("__t")).groupBy("job", stretch.alias("__b")).agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    rows = pages.withColumn("__t", micros).withColumn("__b", stretch)
    own = ends.select("job", "__b", "__first")
    before = ends.select("job", (F.col("__b") + 1).alias("__b"), "__last")
    rows = rows.join(own, ["job", "__b"], "left").join(before, ["job", "__b"], "left")
    stopped = (F.col("__first") <= F.col("__t")) | (F.col("__last") >= F.col("__t") - length)
    return rows.where(~F.coalesce(stopped, F.lit(False))).select(*pages.columns)


def serial_consumer(queued: DataFrame, work: Callable[[int], None], cancelled: Callable[[int], bool], checkpoint: str):
    """Starts the one consumer of a stream of queued jobs (job, created): jobs run one after the other in order of creation, then number. One that is cancelled before its turn is left out; a job's work should ask
    `cancelled` between its pages. A batch that fails is run again as a whole, so work must find out what is done (checkpoint_pages does). The jobs of a batch, numbers alone, come to the driver one partition at a time."""

    def run(batch: DataFrame, _: int) -> None:
        for r in batch.dropDuplicates(["job"]).orderBy("created", "job").toLocalIterator():
            if not cancelled(r.job):
                work(r.job)

    return queued.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
