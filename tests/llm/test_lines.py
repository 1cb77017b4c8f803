"""Line dedup against brute force, with SQL over the same rows."""

import random
from collections import defaultdict

import duckdb
import pyarrow as pa

from quirelake.llm import lines

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, least_chars, least_docs):
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add((i, t))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    pool = ["Home | About", " home | ABOUT\t", "ÄÖ Straße", "äÖ straße", "İstanbul", "x", "\x85", "\x1c", "", "   ", "a\rb", "\r", "one two", "\\n", "中文"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, "Home | About"), (None, None), (None, "Home | About"), (7, "other text of seven\nx"), (503, "Home | About"), (503, "Home | About")]
    # Places over many words of bits, the popular line in the first, a middle and the last of them.
    long = [f"line {i}" for i in range(70_000)]
    long[3] = long[40_000] = long[40_063] = long[-1] = "HOME | about"
    return rows + [(600, "\n".join(long)), (601, "Home | About\n" * 5000 + "end"), (602, "y" * 3_000_000 + "\nx")]


def test_lines_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(f"k{i}", "key", i, t, 1) for i, t in rows], "key1 string, pos string, doc_id long, text string, word int").repartition(5)
    for chars, docs in ((1, 10), (2, 3), (1, 1)):
        found = lines.deduplicated(df, chars, docs)
        assert found.columns == ["doc_id", "n_lines", "n_dropped", "text"]
        assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, chars, docs)
    assert lines.deduplicated(df.limit(0)).count() == 0


def test_sql_over_the_same_rows(spark, tmp_path):
    rows = corpus()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(lines.SQL).fetchall()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, lines.op13_line_dedup(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_a_line_of_a_third_of_all_rows_is_dealt_out_by_document(spark):
    rows = [(i, "The same line\n" + (f"own {i}" if i % 3 else "The same line")) for i in range(6000)]
    marks = lines.line_marks(lines._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r["count"] for r in marks.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(shares) < 1.5 * min(shares)
    text = marks._jdf.queryExecution().toString()
    assert text.split("== Physical Plan ==")[1].count("Exchange") == 1 and "Python" not in text and "Arrow" not in text


def test_bitmaps_are_cut_off_after_the_last_word_that_drops(spark):
    rows = [(i, "\n".join(["pop" if j in (0, 65) else f"{i} {j}" for j in range(1000)])) for i in range(10)]
    marks = lines.line_marks(lines._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    maps = lines.keep_bitmaps(marks, lines.popular_keys(marks)).collect()
    assert len(maps) == 10 and all(m.keep == [-2, -3] for m in maps)
