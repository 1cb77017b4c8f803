"""Comparison of libraries against plain loops."""

import random

from quirelake.operators import compare

ROW = "book long, page int, layer int, w int, h int, bits int, filter string, y int, data binary"


def brute(a, b):
    layers = lambda rows: {k: v for k, v in _grouped(rows).items()}
    la, lb = layers(a), layers(b)
    out = []
    for k in {x[:3] for x in [*la, *lb]}:
        p, q = [{x: v for x, v in side.items() if x[:3] == k} for side in (la, lb)]
        if p == q:
            continue
        why = "missing in b" if not q else "missing in a" if not p else "other shape" if set(p) != set(q) else "other bits"
        bits = None
        if why == "other bits":
            (r,), (s,) = p.values(), q.values()
            pad = lambda x, n: x + b"\0" * (n - len(x))
            bits = sum((int.from_bytes(pad(r.get(y, b""), 9)) ^ int.from_bytes(pad(s.get(y, b""), 9))).bit_count() for y in {*r, *s})
        out.append((*k, why, bits))
    return sorted(out, key=repr)


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[:7]), {})[r[7]] = bytes(r[8])
    return out


def library(rng, change):
    rows = []
    for book in (None, 1, 2, 3):
        for page in range(1, 5):
            for layer in range(2):
                shape = (9, 3, 1 - 7 * (layer - 1) if layer == 0 else 1, "FlateDecode")
                for y in range(3):
                    rows.append([book, page, layer, *shape, y, bytearray([book or 7, page, layer + y])])
    if change:
        rows = [r for r in rows if not (r[0] == 2 and r[1] == 3) and not (r[0] == 3 and r[1] == 1 and r[2] == 1)]
        for r in rows:
            if r[0] is None and r[1] == 2 and r[7] == 1:
                r[8] = bytearray([rng.randrange(256) for _ in range(4)])
            if r[0] == 1 and r[1] == 4 and r[2] == 0:
                r[3] = 10
        rows += [[5, 1, 0, 9, 3, 1, "X", 0, bytearray(b"z")]]
        rows = [r for r in rows if not (r[0] == 1 and r[1] == 1 and r[2] == 1 and r[7] == 2)]
    return rows


def test_differing_layers_match_loops(spark):
    rng = random.Random(1)
    a, b = library(rng, False), library(rng, True)
    df = lambda rows: spark.createDataFrame([tuple(r) for r in rows], ROW).repartition(3)
    got = sorted(map(tuple, compare.differing_layers(df(a), df(b)).collect()), key=repr)
    assert got == brute(a, b) and {r[3] for r in got} == {"missing in a", "missing in b", "other shape", "other bits"}
    report = {r.book: r for r in compare.report(df(a), df(b)).collect()}
    assert report[2].pages_a == 4 and report[2].pages_b == 3 and report[2].templates_compared == report[2].photo_layers_compared == 3 and report[2].verdict == "MISMATCH"
    assert report[5].pages_a == 0 and report[5].mismatches == 1 and report[1].mismatches == 2
    same = compare.report(df(a), df(list(reversed(a)))).collect()
    assert {r.verdict for r in same} == {"IDENTICAL"} and sum(r.templates_compared for r in same) == 16
    assert compare.report(df(a).limit(0), df(a).limit(0)).count() == 0
