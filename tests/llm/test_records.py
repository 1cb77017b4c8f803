"""Round trips and brute force: quality, top-k, mixing, BPE, chat, WARC, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import bpe, chat, mixing, quality, topk, warc
from quirelake.llm.common import new_path


def brute_measure(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    k = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if k[w] > 1 for d in range(3)}
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(lines) if t else 0


def test_quality_measures_and_hosts(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "é", "#", "\n", "  ", "\t", "x<y", "\x1c"]
    texts = [None, "", "\n\n", " "] + ["".join(rng.choice(alphabet) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    for t in texts:
        assert quality.measure(t) == brute_measure(t)
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad words", "bad.example", 1) for i in range(40)] + [(100, good, "bad.example", 1), (101, good, "ok.example", 2), (102, good, None, 3), (103, None, "ok.example", 3), (101, good, "ok.example", 2), (None, good, "few.example", 0)]
    rows += [(200 + i, good, "ok.example", 0) for i in range(20)] + [(300 + i, good, f"h{i}", 0) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert not got[100].base_failed and not got[100].kept and got[101].kept and got[102].kept and not got[103].kept and got[None].kept
    assert quality.judged(df.limit(0)).count() == 0


def test_quality_rejects_a_mixed_host_for_any_rule_that_stands_out(spark):
    """Hosts of 60 documents each, of which some fail one rule; those of bad hosts go whole, those of the others by themselves."""
    words = [f"w{i}" for i in range(60)]
    good, symbols, lines = " ".join(words), " ".join(["<&>", *words, "#" * 40]), "\n".join([" ".join(words), *["same old line"] * 4, "end"])
    few, again = "too few words", " ".join(["round and round"] * 30)
    share = {"few": (few, 40), "again": (again, 39), "symbols": (symbols, 42), "lines": (lines, 45), "half": (symbols, 24), "some": (few, 12), "clean": (few, 0)}
    rows = [(host, text if i < k else good) for host, (text, k) in share.items() for i in range(60)]
    rows += [(f"ok{j}", few if i == j else good) for j in range(20) for i in range(60)] + [("small", few), ("small", good), (None, good)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    failing = {few, again}
    for i, host, text in rows:
        assert got[i].base_failed == (text in failing)
        assert got[i].kept == (text not in failing and host not in ("few", "again", "symbols", "lines")), (host, got[i])

    con = duckdb.connect()
    documents = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "source", "text"))})
    con.register("documents", documents)
    want = con.execute(quality.SQL).fetchall()
    assert sorted(want) == sorted(tuple(r)[:-1] for r in got.values())


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(300, 24)), 2)
    v[50:60] = v[40:50]
    rows = [(int(i), [float(x) for x in e], 0) for i, e in enumerate(v)]
    rows += [(900, None, 0), (901, [1.0, None], 0), (902, [float("nan")] * 24, 0), (None, [1.0] * 24, 0), (903, [1.0, 2.0], 0), (7, rows[7][1], 0), (950, [], 0)]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3))
    got = defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 10 = 0"), df, query_block=13, row_block=40).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = [(i, np.floor(256 * np.array(e, np.float32).astype(float))) for i, e, _ in rows if i is not None and e and all(x is not None and x == x for x in e)]
    for q, e in whole:
        if q % 10 == 0:
            best = sorted((-int(e @ f), i) for i, f in whole if i != q and len(f) == len(e))[:5]
            assert sorted(got.pop(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    big = topk.Columns(np.array([1, 2, 0]), np.array([[2.0**40, 3.0], [2.0**40, 2.0], [1.0, 1.0]]))
    assert big.search([0], np.array([[2.0**20, 1.0]]), 1) == [[(-(2**60 + 3), 1)]]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_with_outlying_components(spark):
    """Outlying rows and queries are exact, others of the same block as well; scores beyond long are the nearest long."""
    rng = np.random.default_rng(13)
    v = np.round(rng.normal(size=(200, 8)), 2)
    v[::17] *= 10.0 ** rng.integers(3, 30, len(v[::17]))[:, None]
    v[5], v[7] = 1e300, -1e300
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(300, [1e20, 1.0] + [0.0] * 6), (310, [1e308] * 8), (320, [7e305] * 8), (0, [1.0] * 8), (0, [-1.0] * 8)]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2))
    whole = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows if all(np.isfinite(256 * x) for x in e)]
    assert len(whole) == len(rows) - 1
    got = defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 5 = 0"), df, query_block=20, row_block=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ask = {i: min(e for j, e in whole if j == i) for i, _ in whole if i % 5 == 0}
    for q, e in ask.items():
        score = lambda f: max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(e, f))))
        best = sorted((-score(f), i) for i, f in whole if i != q)[:5]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert not got


def test_mixing_rates_and_repeatability(spark):
    rows = [(i, "t", "big" if i % 3 else None, "c") for i in range(3000)] + [(10_000 + i, None, "small", "c") for i in range(30)] + [(None, "", "small", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string").repartition(4)
    got = mixing.replicated(df, {"big": 1.0, "small": 2.0}, epochs=4.0)
    rows1 = sorted((str(r.doc_id), r.copy, r.shuffle_key) for r in got.collect())
    assert rows1 == sorted((str(r.doc_id), r.copy, r.shuffle_key) for r in mixing.replicated(df.repartition(2), {"big": 1.0, "small": 2.0}, epochs=4.0).collect())
    n = Counter(r.source for r in got.collect())
    total = 4 * len(rows)
    assert abs(n["big"] / (total / 3) - 1) < 0.1 and abs(n["small"] / (total * 2 / 3) - 1) < 0.1 and None not in n
    assert len({(a, b) for a, b, _ in rows1 if a != "None"}) == sum(a != "None" for a, _, _ in rows1)
    assert mixing.replicated(df.limit(0)).count() == 0
    table = spark.range(1).select(mixing.poisson_table(mixing.F.lit(2.5)).alias("t")).first().t
    p, c = np.exp(-2.5), 0.0
    for k, x in enumerate(table):
        c += p
        assert abs(x - c) < 1e-12
        p *= 2.5 / (k + 1)


def test_mixing_rows_without_ids_draw_apart(spark):
    rows = [(None, f"text {i}", "a") for i in range(3000)] + [(i, "t", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for seed in (17, 19, 20):
        n = Counter(r.text for r in mixing.replicated(df, {"a": 1.0, "b": 1.0}, seed=seed).where("doc_id IS NULL").collect())
        assert abs(sum(n.values()) - 3000) < 250 and abs(3000 - len(n) - 3000 / np.e) < 200
    got = mixing.replicated(df, seed=17).where("doc_id IS NULL")
    assert got.select("shuffle_key").distinct().count() == got.count()


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.vocabulary()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "'s", "'", "ll", "a", "É", "中", "😀", "é", "1", "２", "!", "<|endoftext|>", "​", "﻿", "\r\n", "don't", "ing", "×", "ɏ", "ɐ", "²", "_", "-", "#", "[", "]", "\\", "^", "`", "~"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400)), "word " * 5000, "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.encoded(docs, path, pattern, with_offsets=True)
    for r in rows.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == other.encode_ordinary(t)
        at = 0
        for i, s, e in zip(r.ids, r.starts, r.ends):
            piece = other.decode_single_token_bytes(i)
            assert piece in t[s:e].encode() and s <= at <= e
            at = e
    assert {r.doc_id: r.text for r in bpe.decoded(rows, path, pattern).collect()} == {i: t or "" for i, t in enumerate(texts)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.digests(docs, path, pattern).collect():
        ids = other.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((texts[r.doc_id] or "").encode()))
    assert bpe.digests(docs.limit(0), path, pattern).count() == 0


def test_bpe_with_a_full_table_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 8)
    coder = bpe.Bpe(*bpe.vocabulary())
    words = ["one", " two", " three!", " four-five", "\n", " six", " seven's"]
    rng, most = random.Random(3), 4  # a half holds 4 pieces, or those of one text
    for n in (1, 2, 5, 40):
        for _ in range(30):
            text = "".join(rng.choice(words) for _ in range(n))
            assert coder.encode(text) == coder.tokenizer.encode(text, add_special_tokens=False).ids
            most = max(most, len(set(bpe._PIECE.findall(text))))
            assert max(len(coder.held), len(coder.before)) <= most and coder.decode(coder.encode(text)) == text.encode()
    coder.forget()
    assert not coder.held and not coder.before


def test_bpe_with_another_pattern_clashing_columns_and_repeats(spark):
    import tiktoken

    path, _ = bpe.vocabulary()
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = ["x!\n\ny", "one.\n\ntwo", "a  b\tc 12345", "", "É's über—naïve\r\n"] * 3
    docs = spark.createDataFrame([(i // 2, t, "n", [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids array<int>")
    got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encoded(docs, path, pattern).collect())
    assert got == sorted((i // 2, tuple(other.encode_ordinary(t))) for i, t in enumerate(texts))


CONVERSATIONS = {
    1: [("user", "hi # <b>"), ("assistant", "a\\b </turn>\n")],
    2: [("user", "hi # <b>"), ("assistant", "other")],
    3: [("user", "hi # <b>"), ("assistant", "a\\b </turn>\n"), ("user", None), ("assistant", "")],
    4: [(None, "x"), ("we\nird\\n", "### user\n")],
    5: [("user", "hi # <b>"), ("assistant", "a\\b </turn>\n")],
}


@pytest.mark.parametrize("size", [1, 60, 1 << 16])
def test_chat_round_trip_and_shared_turns(spark, size):
    rows = [(c, i, r, t, "x") for c, turns in CONVERSATIONS.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chain string").repartition(3)
    packs, members, digests = chat.formatted(df, size)
    got = {r.conv_id: r for r in members.join(digests, "chain").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in CONVERSATIONS.items():
        turns = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(chat.format_turn(r, t)[0]) for r, t in turns))
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == want
    for p in packs.collect():
        for i, n in enumerate(p.nodes):
            line, j = [], i
            while j >= 0:
                line.append(p.nodes[j])
                j = p.nodes[j].parent
            assert n.position == sum(a.end - a.start for a in line[1:])
            assert {x for a, b in zip(n.attends[::2], n.attends[1::2]) for x in range(a, b)} == {x for a in line[1:] for x in range(a.start, a.end)}
    if size > 60:
        assert sum(len(p.nodes) for p in packs.collect()) <= 7 + 2 * (packs.count() - 1)
    assert chat.formatted(df.limit(0))[2].count() == 0


def test_chat_shared_turns_longer_than_a_pack(spark):
    first = "shared words " * 6000
    rows = [(i, 0, "user", first) for i in range(200)] + [(i, 1, "assistant", f"answer {i}") for i in range(200)]
    rows += [(1000, 0, "user", None), (1000, 0, "user", None), (1000, None, "assistant", "first"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    packs, members, digests = chat.formatted(df)
    held = packs.collect()
    spark_tasks = 4
    assert sum(len(p.text) for p in held) < 2 * (spark_tasks + 1) * len(first)  # one task's range or two hold the shared turn, not 200
    got = members.join(digests, "chain").collect()
    assert len(got) == 204 and sorted(r.n_turns for r in got if r.conv_id is None) == [1, 1, 1]
    odd = next(r for r in got if r.conv_id == 1000)
    assert odd.turns_sha256 == hashlib.sha256(b"assistant\nfirst\nuser\n\nuser\n\n").hexdigest()
    for p in held[:2]:
        ids = chat.position_ids([n.asDict() for n in p.nodes])
        assert len(ids) == len(p.text) and all(ids[n.start] == n.position and ids[n.end - 1] == n.position + n.end - n.start - 1 for n in p.nodes)


def test_chat_reads_very_long_turns_in_a_few_copies():
    import tracemalloc

    text = "a <b> # \\\\</turn>\n" * 500_000
    formatted = chat.format_turn("user", text)[0] + chat.format_turn("assis\\tant\n", "\\")[0]
    tracemalloc.start()
    assert chat.parse(formatted) == [("user", text), ("assis\\tant\n", "\\")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(formatted)
    for bad in ("### user\ntext", "## x\n</turn>\n", "### user\na\\</turn>\n", "### user"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_chat_pack_ends_by_what_is_added():
    turn = lambda t: {"role": "user", "text": t}
    key = lambda *names: "".join(n * chat.DIGITS for n in names)
    pack, packs, last = chat.Pack(), [], ""
    for i in range(40):
        if pack.full(500):
            packs.append(pack)
            pack = chat.Pack()
        chain = key("a", chr(ord("A") + i))
        pack.add(chain, [turn("x" * 2000), turn("y" * 100)], last if not pack.nodes else "")
        last = chain
    packs.append(pack)
    total = sum(p.size for p in packs)
    needed = len(chat.format_turn("user", "x" * 2000)[0]) + 40 * len(chat.format_turn("user", "y" * 100)[0])
    assert needed < total < 2 * needed and len(packs) > 2 and packs[0].again == 0 and packs[1].again > 2000


def test_warc_round_trip(spark):
    big, other = "x" * 1500, "é" * 900
    rows = [(5, "http://a/é\r\nX: 1", big, 1), (9, None, big, 1), (7, "http://b", big, 1), (1, "u", "short", 1), (2, "u", "short", 1), (3, "u", None, 1), (4, "u", "", 1), (None, "n", "z", 1), (11, "m", other, 1), (9, None, big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    uri = new_path(spark, "warc")
    manifest = warc.write_warc(df, uri, roll=300)
    back = warc.read_warc(manifest, uri, payloads=True).collect()
    assert len(back) == len(rows) and manifest.count() > 2 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    for r in back:
        html = next((h or "").encode() for i, _, h, _ in rows if i == r.page_id)
        revisit = r.page_id in (5, 7)
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload == (b"" if revisit else html)
    again = warc.write_warc(df.repartition(2), other_uri := new_path(spark, "warc"), roll=300)
    assert sorted(r.sha1 for r in again.collect()) == sorted(r.sha1 for r in manifest.collect()) and other_uri != uri
    empty = warc.write_warc(df.limit(0), uri := new_path(spark, "warc"))
    assert empty.count() == 0 and warc.read_warc(empty, uri).count() == 0


def test_warc_record_ids_are_distinct_and_references_live(spark):
    x, y = "x" * 2000, "y" * 2000
    rows = [(5, "u", x), (5, "u", y), (1, "u", y), (5, "v", x), (5, "u", x), (5, None, x), (2, "u", x), (None, "u", x), (None, "w", x), (None, "u", x), (3, "u", "s"), (3, "u", "t"), (3, "u", "s"), (None, None, y)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest = warc.write_warc(df, uri := new_path(spark, "warc"), roll=900)
    from pyarrow import fs as pafs

    fs, folder = pafs.FileSystem.from_uri(uri)
    found = [f for m in manifest.collect() for f, _ in warc.read_records(fs.open_input_stream(f"{folder}/{m.file}", compression=None))]
    ids = [f["WARC-Record-ID"] for f in found]
    responses = {f["WARC-Record-ID"] for f in found if f["WARC-Type"] == "response"}
    assert len(ids) == len(set(ids)) == len(rows)
    revisits = [f for f in found if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 6 and all(f["WARC-Refers-To"] in responses for f in revisits)


def test_warc_gives_the_same_archives_from_any_layout(spark):
    rng = random.Random(12)
    rows = [(i * i % 7919 * 1000 + i % 3, f"http://h/{i}", "".join(rng.choice("abc <>é") for _ in range(rng.randint(0, 1500)))) for i in range(6000)]
    rows += [(None, f"n{i}", "x" * i) for i in range(50)] + [(5000, "hot", f"{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for layout in (df.repartition(7), df.repartition(3, "url"), df.orderBy("html")):
        manifest = warc.write_warc(layout, uri := new_path(spark, "warc"), roll=40_000, shard=400_000)
        files = sorted(manifest.select("file", "records", "bytes", "sha1", "first_page_id", "last_page_id").collect())
        seen.append(files)
        assert warc.read_warc(manifest, uri).count() == len(rows)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 20
    firsts = [f.first_page_id for f in seen[0] if f.first_page_id is not None]
    assert firsts == sorted(firsts)
    assert not pafs_names(uri, "_temporary")


def pafs_names(uri, part):
    from pyarrow import fs

    found, folder = fs.FileSystem.from_uri(uri)
    return [x.path for x in found.get_file_info(fs.FileSelector(folder)) if part in x.path]


def test_pipeline_stages(spark):
    import corpus_pipeline

    good = lambda k: " ".join(f"word{chr(97 + i % 26)}{k}x{i}" for i in range(80))
    rows = [(1, good(1), "en", "a", 1, "q"), (2, good(1), "en", "b", 1, "q"), (3, "short", "en", "a", 1, "q"), (4, None, None, None, 1, "q"), (5, good(2), "en", None, 1, "q"), (None, good(3), "en", "b", 1, "q"), (None, good(3), "en", "b", 1, "q"), (5, good(2), "en", None, 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = corpus_pipeline.written(stage(spark, kept, ""), name)
        assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "None"]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
