"""Summed-area tables, ranks and passages against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.operators import needles, sums
from quirelake.operators.ranks import ranked


def rows_of(planes):
    return [(p, y, x, int(v[y, x])) for p, v in planes.items() for y in range(v.shape[0]) for x in range(v.shape[1])]


@pytest.mark.parametrize("radius", [0, 2, 30])
def test_box_sums_match_loops(spark, radius):
    rng = np.random.default_rng(radius)
    planes = {1: rng.integers(0, 256, (11, 7)), 2: rng.integers(0, 256, (1, 9))}
    px = spark.createDataFrame(rows_of(planes), "page long, y int, x int, gray int").repartition(4)
    got = {(r.page, r.y, r.x): (r.total, r.n) for r in sums.box_sums(px, "gray", radius).collect()}
    for p, y, x, _ in rows_of(planes):
        part = planes[p][max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
        assert got[p, y, x] == (part.sum(), part.size)
    assert sums.box_sums(px.limit(0), "gray", 2).count() == 0


@pytest.mark.parametrize("side,new", [(9, 4), (8, 4), (7, 7), (10, 1), (7, 5)])
def test_area_means_match_loops(spark, side, new):
    plane = np.random.default_rng(side).integers(0, 256, (side, side))
    px = spark.createDataFrame(rows_of({5: plane}), "page long, y int, x int, gray int")
    fine = np.kron(plane, np.ones((new, new), int))
    want = [[(2 * fine[i * side : (i + 1) * side, j * side : (j + 1) * side].sum() + side * side) // (2 * side * side) for j in range(new)] for i in range(new)]
    got = {(r.y, r.x): r.gray for r in sums.area_resized(px, "gray", side, new).collect()}
    assert got == {(i, j): want[i][j] for i in range(new) for j in range(new)}


def test_ranks_over_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2, 9]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "v int, id long").repartition(7)
    got = {r.id: r.rank for r in ranked(df, F.desc("v"), F.asc("id")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r[1]: k for k, r in enumerate(want)}
    assert ranked(df.limit(0), "v", "id").count() == 0


def test_needles_match_search(spark):
    rng = random.Random(5)
    words = ["a", "b", "aa", "ab", "é", "x.", "中", ""]
    texts = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "b a a a a a b"), (902, "b a a a a a b")]
    passages = [(k, " ".join(rng.choice(words[:7]) for _ in range(rng.randint(3, 5)))) for k in range(40)] + [(80, None), (81, "a a a"), (81, "a a a"), (82, "no such words here"), (83, "a a a a")]
    want = sorted(((i, k, at + 1) for i, t in texts if t for k, p in passages if p for at in range(len(t)) if t.startswith(p, at)), key=repr)
    t, p = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(passages, "item_id long, passage string")
    assert sorted(map(tuple, needles.hits(t, p).collect()), key=repr) == want and len(want) > 100
    assert needles.hits(t.limit(0), p).count() == needles.hits(t, p.limit(0)).count() == 0
    with pytest.raises(Exception, match="under three words"):
        needles.hits(t, spark.createDataFrame([(1, "two words")], "item_id long, passage string")).count()
