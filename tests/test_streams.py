"""Streams fed batch by batch, out of order."""

import json

from pyspark.sql import functions as F

from quirelake.streaming import jobs


def batches(spark, folder, schema, groups, start):
    """Feeds each group of rows as a batch of its own to the query that start(stream) gives."""
    folder.mkdir()
    for i, rows in enumerate(groups):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        start(spark.readStream.schema(schema).json(str(folder))).awaitTermination(120)


def test_late_and_repeated_lines_count_once(spark, tmp_path):
    line = lambda seq, text: {"job": 1, "seq": seq, "line": text}
    last = {}
    keep = lambda df: df.writeStream.outputMode("update").foreachBatch(lambda b, _: last.update({r.job: r for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    groups = [[line(5, "OCR 10/100")], [line(7, "saved"), line(4, "total time"), line(5, "OCR 10/100")], [line(6, "page 50/100 done"), line(1, "plan: pages 9")]]
    batches(spark, tmp_path / "in", "job long, seq long, line string", groups, lambda s: keep(jobs.job_progress(s)))
    assert (last[1].seq, last[1].stage, last[1].progress, last[1].n_lines) == (7, "enhancing", 1.0, 5)


def test_only_the_ring_lets_lines_go(spark, tmp_path):
    line = lambda seq, text: {"job": 1, "seq": seq, "line": text}
    last = {}
    keep = lambda df: df.writeStream.outputMode("update").foreachBatch(lambda b, _: last.update({r.job: r for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    groups = [[line(i, "x") for i in range(20, 24)], [line(100, "page 1/10 done"), line(99, "y")], [line(3, "rebuild pdf"), line(97, "z"), line(99, "y")], [line(101, "w"), line(2, "total time")]]
    batches(spark, tmp_path / "in", "job long, seq long, line string", groups, lambda s: keep(jobs.job_progress(s, 3)))
    # Lines 98..100 or 99..101 can be held; the late lines still count for stage and progress.
    assert (last[1].seq, last[1].stage, last[1].progress, last[1].n_lines) == (101, "enhancing", 1.0, 3)


def test_states_are_put_in_order_over_batches(spark, tmp_path):
    step = lambda job, at, status: {"job": job, "at": at * 1000, "status": status}
    out = []
    keep = lambda df: df.writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    groups = [[step(1, 103, "running"), step(2, 101, "running")], [step(1, 102, "queued"), step(1, 101, "draft"), step(2, 105, "queued")], [step(1, 104, "done"), step(1, 105, "running"), step(2, 106, "stopped")], [step(9, 900, "draft")], [step(9, 1000, "draft")]]
    batches(spark, tmp_path / "in", "job long, at long, status string", groups, lambda s: keep(jobs.job_states(s)))
    per = {j: [(r.at // 1000, r.status, r.refused) for r in sorted(out, key=lambda r: r.at) if r.job == j] for j in (1, 2)}
    assert per == {1: [(101, "draft", 0), (102, "queued", 0), (103, "running", 0), (104, "done", 0), (105, "done", 1)], 2: [(101, None, 1), (105, "queued", 1), (106, "stopped", 1)]}
    assert {r.created for r in out if r.job == 1} == {101_000}


def test_pages_of_stopped_jobs_are_left_out_once(spark, tmp_path):
    at = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00"
    pages = [[{"job": 1, "page": m, "time": at(m)} for m in (0, 30, 90)], [{"job": 1, "page": 100, "time": at(100)}, {"job": 2, "page": 95, "time": at(95)}], [{"job": 3, "page": 600, "time": at(600)}], [{"job": 3, "page": 900, "time": at(900)}]]
    stops = [[{"job": 1, "time": at(40)}], [{"job": 1, "time": at(41)}, {"job": 2, "time": at(96)}], [{"job": 4, "time": at(600)}], [{"job": 4, "time": at(900)}]]
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    out = []
    for n in ("p", "s"):
        (tmp_path / n).mkdir()
    for i, (p, s) in enumerate(zip(pages, stops)):
        (tmp_path / "p" / f"{i}.json").write_text("\n".join(map(json.dumps, p)))
        (tmp_path / "s" / f"{i}.json").write_text("\n".join(map(json.dumps, s)))
        df = jobs.not_stopped(read("p", "job long, page int, time timestamp"), read("s", "job long, time timestamp"))
        df.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.job, r.page) for r in out if r.job < 3)
    table = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for g in rows for r in g], schema).withColumn("time", F.to_timestamp("time"))
    batch = jobs.not_stopped(table(pages, "job long, page int, time string"), table(stops, "job long, time string"))
    assert got == sorted((r.job, r.page) for r in batch.collect() if r.job < 3) == [(1, 0), (1, 30), (2, 95)]


def test_one_consumer_takes_jobs_in_order(spark, tmp_path):
    ran = []
    groups = [[{"job": 3, "created": 1}, {"job": 1, "created": 9}, {"job": 2, "created": 1}, {"job": 3, "created": 1}], [{"job": 5, "created": 2}]]
    batches(spark, tmp_path / "in", "job long, created long", groups, lambda s: jobs.serial_consumer(s, ran.append, lambda j: j == 1, str(tmp_path / "cp")))
    assert ran == [2, 3, 5]


def test_a_batch_reads_of_the_store_what_it_may_repeat(spark, tmp_path):
    rows = spark.createDataFrame([(s, p) for s in "abc" for p in range(1000)], "sig string, page int")
    rows.repartitionByRange(4, "page").sortWithinPartitions("page").write.partitionBy("sig").parquet(str(tmp_path / "store"))
    batch = spark.createDataFrame([("b", 10), ("b", 20), ("b", 5000)], "sig string, page int")
    near = jobs.stored_near(batch.where("page < 100"), str(tmp_path / "store"))
    assert near.count() == 11
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page), GreaterThanOrEqual(page,10), LessThanOrEqual(page,20)]" in plan and "PartitionFilters: [isnotnull(sig" in plan
    assert batch.join(jobs.stored_near(batch, str(tmp_path / "store")), ["sig", "page"], "left_anti").collect()[0].page == 5000
