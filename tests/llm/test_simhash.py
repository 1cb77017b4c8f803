import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from quirelake.llm import near_copies, simhash
from quirelake.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, fps):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r is not None:
            low[root(i)] = min(r, low.get(root(i), r))
    return [low.get(root(i)) for i in range(len(rows))]


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeÀßñ") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(60, 400))) for _ in range(12)]
    out = [None, "", " \n\t", "one", "One  TWO", "one two", "a\x0bb c d\x1ce"]
    for t in base:
        out.append(t)
        for _ in range(4):
            w = t.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            out.append("\n".join(w))
    return out


def test_fingerprint_and_components(spark):
    got_texts = texts()
    ids = [100 - i for i in range(len(got_texts))]
    ids[3] = None
    rows = list(zip(ids, got_texts, got_texts)) + [(100, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip(map(str, ids + [100]), [f"{f:016x}" for f in fps], map(str, brute_components([r[0] for r in rows], fps))))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_long_text_in_blocks(monkeypatch):
    text = "Ab cé d\nEf  gh " * 300
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "word_blocks", lambda d: simhash.__dict__["_blocks"](d))
    from quirelake.llm.common import word_blocks

    monkeypatch.setitem(simhash.__dict__, "_blocks", lambda d: word_blocks(d, 40))
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def near_codes(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    out = rng.integers(0, 2**63, n, dtype=np.uint64)
    for i in range(n // 2):
        out[i] = base[i % 5] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5), dtype=np.uint64))
    return np.unique(out)


def test_index_finds_all_pairs():
    codes = near_codes(700, 3)
    index = simhash.GrayIndex(codes, 0)
    q, c = index.search(index.codes, 3, np.full(len(codes), -1))
    want = np.argwhere(np.bitwise_count(index.codes[:, None] ^ index.codes[None]) <= 3)
    assert sorted(zip(q.tolist(), c.tolist())) == sorted(map(tuple, want.tolist()))


def test_large_nodes_go_to_finer_cuts(spark):
    codes = near_codes(500, 4)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    want = brute_components(list(range(len(codes))), [int(x) for x in codes])
    for large in (5, 2000):
        root = {r.node: r.root for r in connected_components(simhash.links(df, large=large)).collect()}
        mine = [root.get(int(x), int(x)) for x in codes.view(np.int64)]
        assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_empty(spark):
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


def jaccard(a, b):
    a, b = set(near_copies.shingle_set(a).tolist()), set(near_copies.shingle_set(b).tolist())
    return 1.0 if a == b else len(a & b) / len(a | b)


def brute_groups(texts):
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                links.append((j, i))
                up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))], links


def edited(rng, words, rate):
    return [w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in words]


def test_near_copies_match_brute_force(spark):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(2000)]
    texts = [None, "", " \n", "one two", "One two", "one two three four"]
    for _ in range(120):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        texts += [" ".join(base), *(" ".join(edited(rng, base, rng.choice([0.002, 0.01, 0.02, 0.04]))) for _ in range(rng.randint(0, 4)))]
    rng.shuffle(texts)
    ids = [3 * i + 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, i % 5, "q") for i, t in zip(ids, texts)], "doc_id long, text string, row int, s string").repartition(3)
    want, links = brute_groups(texts)
    got = {r.doc_id: r.root for r in near_copies.groups(docs).collect()}
    found = [got[i] for i in ids]
    held = sum(found[a] == found[b] for a, b in links)
    assert held >= 0.97 * len(links), (held, len(links))
    # No group is larger than the true one.
    true = {}
    assert all(true.setdefault(f, w) == w for f, w in zip(found, want))
    kept = near_copies.deduplicated(docs)
    assert kept.columns == docs.columns
    least = {}
    for f, i in zip(found, ids):
        least[f] = min(i, least.get(f, i))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_near_copies_with_large_nodes_and_odd_rows(spark):
    rng = random.Random(22)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, 0.004)) for _ in range(150)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(50)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, texts[-1], None), (None, texts[-1], None), (190, texts[190], None), (190, texts[190], 2.5), (None, "alone here", 1.0), (None, "alone here", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, maybe double").repartition(3)
    want, links = brute_groups(texts)
    for large in (10, 2000):
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.maybe or 0) for r in near_copies.deduplicated(docs, large=large).collect())
        assert len(kept) <= len(set(want)) + 2 and kept[-1] == (True, 0, 1.0) and sum(k[0] for k in kept) == 1, kept
        assert sum(k[1] == 190 for k in kept) == 1
    empty = near_copies.deduplicated(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def test_wide_index_gives_all_pairs_and_tables_reach_their_recall():
    rng = np.random.default_rng(23)
    codes = rng.integers(0, 2**63, (300, 4), dtype=np.uint64)
    codes[150:] = codes[:150] ^ (np.uint64(1) << rng.integers(0, 64, (150, 4), dtype=np.uint64))
    index = simhash.GrayIndex(codes)
    q, c, d = index.near(index.codes, 40, np.full(300, -1))
    whole = np.bitwise_count(index.codes[:, None] ^ index.codes[None]).sum(axis=2)
    assert sorted(zip(q.tolist(), c.tolist(), d.tolist())) == sorted((a, b, whole[a, b]) for a, b in np.argwhere(whole <= 40).tolist())
    for classes in (10, 10**6, 5 * 10**10):
        masks = near_copies.tables(classes)
        bits = int(np.bitwise_count(masks[0]).sum())
        assert 1 - (1 - (1 - near_copies.share_of_bits(0.8)) ** bits) ** len(masks) >= near_copies.RECALL
        assert classes / 2**bits <= 1 / 16


def borderline():
    """Families whose members lie close to similarity 0.8, and a passage that most texts share."""
    rng = random.Random(24)
    passage = [f"p{i}" for i in range(14)]
    texts = []
    for k in range(70):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 160))] + (passage if k % 4 else [])
        texts += [" ".join(edited(rng, base, 0.022)) for _ in range(rng.randint(2, 4))]
    texts += [" ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(k % 9))]) for k in range(60)]
    rng.shuffle(texts)
    return texts


def test_near_copies_leave_out_no_link(spark):
    texts = borderline()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, links = brute_groups(texts)
    for large in (10, 2000):
        got = {r.doc_id: r.root for r in near_copies.groups(docs, large=large).collect()}
        lost = [(a, b) for a, b in links if got[a] != got[b]]
        assert not lost, (large, len(lost), len(links))
        assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))


def test_pairs_of_buckets_over_batches_and_sides():
    rng = np.random.default_rng(25)
    n = 400
    sets = [np.unique(rng.choice(5000, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    sets = [np.unique(np.where(rng.random(len(s)) < 0.06, rng.integers(0, 2**63, len(s), dtype=np.uint64), s)) for s in (sets[i % 40] for i in range(n))]
    frequent = np.zeros(1 << 10, np.uint8)
    frequent[rng.choice(1 << 10, 100)] = 9
    want = {(i, j) for j in range(n) for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert len(want) > 200
    rows = []
    for i, h in enumerate(sets):
        for place, key in enumerate(near_copies.prefix(h, frequent).view(np.int64).tolist()):
            # Buckets of even keys are dealt out over two sides.
            for part in (0, 1, 3) if key % 2 == 0 else (0,):
                side = i % 2 if key % 2 == 0 else 0
                if key % 2 or part == 1 or part == 3 * side:
                    rows.append((key, part, side, part == 1, i, i, len(h), place, *near_copies.parities(h).view(np.int64).tolist()))
    rows.sort(key=lambda r: r[:2])
    names = ["key", "part", "side", "across", "s", "root", "n", "place", *near_copies.ODD]
    for size in (1, 7, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=names) for i in range(0, len(rows), size)]
        found = {}
        for b in near_copies._bucket_pairs(0.8)(iter(batches)):
            for x, y, least, times in zip(*(c.to_pylist() for c in b.columns)):
                found.setdefault((x, y, least), []).append(times)
        assert want <= {(x, y) for (x, y, least), times in found.items() if sum(times) >= least}


def test_pairs_to_check_grow_with_links_not_with_the_square_of_a_family(spark, monkeypatch):
    # Copies of one text, most of them less alike than asked for, so that each is a group of its own.
    rng = random.Random(26)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(edited(rng, base, 0.025)) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, links = brute_groups(texts)
    assert len(set(want)) > 50
    checked, real = [], near_copies.across

    def across(*args):
        out = real(*args)
        checked.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "across", across)
    for large in (10, 2000):
        got = {r.doc_id: r.root for r in near_copies.groups(docs, large=large).collect()}
        assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))
    assert max(checked) <= len(texts), (checked, len(links), len(set(want)))


def test_folded_parities_never_exceed_the_hashes_that_differ():
    rng = np.random.default_rng(27)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 5, 33, 60, 300, 300, 2000, 40000)]
    sets += [np.unique(np.concatenate([h[len(h) // 9 :], rng.integers(0, 2**63, len(h) // 5, dtype=np.uint64)])) for h in sets]
    wide = [near_copies.wide_parities(h) for h in sets]
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    whole = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    for most in (1, 1 << 20):
        found = near_copies.cells_apart(wide, i, j, most)
        assert (found <= whole).all() and (found[i == j] == 0).all()
    # A pair at similarity 0.75 is told from one at 0.8.
    a = np.unique(rng.integers(0, 2**63, 700, dtype=np.uint64))
    b = np.concatenate([a[100:], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    assert near_copies.cells_apart([near_copies.wide_parities(x) for x in (a, b)], np.array([0]), np.array([1]))[0] > 1400 - 2 * near_copies.least_overlap(1400)
