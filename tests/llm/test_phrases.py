"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import phrases
from quirelake.llm.common import Bitmap


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, longest, least, scale, share, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        longer = [(p, a) for p, a in c.items() if len(p) > 2 and a >= least]
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in longer):
                continue
            score, k = min((scale * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus():
    rng = random.Random(2)
    words = ["of", "the", "New", "york", "CITY", "État", "état", "|", "a-b", "\x1c", "naïve", "\x00", "中文", "in", "\x85"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r"]) for _ in range(rng.randint(0, 25)))
        rows.append((text + (" New York City of the Dead" if i % 3 else ""), rng.choice(["en", "en", None, "und", ""])))
    rows += [("same old piece of text again and again", "en")] * 60 + [(None, "en"), ("", None), (" \t ", "fr"), ("rare words only", "de"), ("x " * 3000, "xx"), ("x y " * 2000 + "z", "en")]
    return rows


@pytest.mark.parametrize("longest,least,share,top", [(5, 20, 100, 2000), (3, 10, 50, 7), (4, 5, 100, 50)])
def test_collocations_match_brute_force(spark, longest, least, share, top):
    rows = corpus()
    df = spark.createDataFrame([(1, *r, "p", 2) for r in rows], "m int, text string, lang string, phrase string, n int").repartition(6)
    found = phrases.collocations(df, longest, least, share=share, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, longest, least, 1000, share, top)


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([("few words here", "en")], "text string, lang string")).count() == 0


def test_blocks_count_each_phrase_once():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    langs, m = ["en" if i % 2 else "fr" for i in range(30)], np.arange(1, 31)
    for k in range(1, 6):
        want = Counter()
        for lang, t, x in zip(langs, texts, m):
            w = t.split()
            for i in range(len(w) - k + 1):
                want[lang, " ".join(w[i : i + k])] += x
        for block in (1, 3, 1 << 19):
            got = Counter()
            for b in phrases.phrases_of(pa.array(langs), pa.array(texts), m, k, None, block):
                for r in b.to_pylist():
                    got[r["lang"], r["phrase"]] += r["m"]
            assert got == want


def test_runs_hold_all_longer_phrases_of_known_pairs(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    langs, m = ["en" if i % 2 else "fr" for i in range(60)], np.arange(1, 61)
    good = {("en", "a b"), ("en", "b c"), ("fr", "b a"), ("en", "c a"), ("fr", "a a"), ("en", "a a")}
    keys = phrases.phrase_keys(pa.array([g[0] for g in good]), pa.array([g[1] for g in good]))

    class Known:
        def has(self, h):
            return np.isin(h.view(np.int64), keys)

    want = Counter()
    for lang, t, x in zip(langs, texts, m):
        run = []
        for w in [*t.split(), None]:
            if run and (lang, f"{run[-1]} {w}") in good:
                run.append(w)
            else:
                if len(run) > 2:
                    want[lang, " ".join(run)] += x
                run = [w]
    for block in (1, 1 << 19):
        monkeypatch.setattr(phrases, "BLOCK", block)
        got = Counter()
        for b in phrases.runs_of(pa.array(langs), pa.array(texts), m, Known()):
            for r in b.to_pylist():
                got[r["lang"], r["piece"]] += r["m"]
        assert got == want and want


def test_phrases_have_one_hash_in_pieces_and_in_tables():
    class Seen:
        def has(self, h):
            self.h = h
            return np.ones(len(h), bool)

    seen = Seen()
    list(phrases.phrases_of(pa.array(["en"]), pa.array(["one two three four"]), np.array([1]), 4, seen))
    assert seen.h.view(np.int64).tolist() == phrases.phrase_keys(pa.array(["en", "en"]), pa.array(["one two three", "two three four"])).tolist()


def test_arithmetic_beyond_64_bits(spark):
    big = 3 * 10**12
    t = lambda rows: spark.createDataFrame([(*r, 0) for r in rows], phrases.COUNTS)
    tables = [t([("en", "a", big), ("en", "b", big - 1)]), t([("en", "a b", big - 7)])]
    row = phrases.scored(tables, spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long")).first()
    assert row.score == 1000 * (big - 7) * (9 * 10**12) // (big * (big - 1)) and (row.l, row.r) == (big, big - 1)


def test_hashes_leave_a_task_as_sums_by_bucket(monkeypatch):
    rng = random.Random(3)
    texts = [", ".join(" ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 30))) for _ in range(20)) for _ in range(300)]
    langs, m = [rng.choice(["en", "fr"]) for _ in texts], [1] * 150 + [rng.randint(1, 9) for _ in range(150)]
    want = Counter()
    for text, lang, x in zip(texts, langs, m):
        for piece in low(text).split(","):
            words = piece.split()
            for k in (1, 2, 3):
                want.update({(lang, " ".join(words[i : i + k])): 0 for i in range(len(words) - k + 1)})
                for i in range(len(words) - k + 1):
                    want[lang, " ".join(words[i : i + k])] += x
    keys = phrases.phrase_keys(pa.array([g[0] for g in want]), pa.array([g[1] for g in want])).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts), pa.array(m)], names=["lang", "piece", "m"])
    monkeypatch.setattr(phrases, "BUCKETS", 64)
    for block, most in ((1 << 19, 1 << 21), (7, 1 << 21), (1 << 19, 20000)):
        monkeypatch.setattr(phrases, "BLOCK", block)
        monkeypatch.setattr(phrases, "KEYS", most)
        found = list(phrases._hash(range(1, 4))([batch.slice(0, 150), batch.slice(150)]))
        got, bucket_of = Counter(), {}
        for rows in found:
            assert len(rows) <= 64 < sum(map(len, rows.column("keys").to_pylist())) / 8
            for r in rows.to_pylist():
                for key, x in zip(r["keys"], r["sums"], strict=True):
                    got[key] += x
                    assert bucket_of.setdefault(key, r["bucket"]) == r["bucket"]
        assert got == Counter(dict(zip(keys, want.values()))) and len(got) == len(want)


def test_words_meet_breaks_and_ends_of_texts():
    texts = ["Ab", "cD  e\tf", "", "x.Y z", ". ,", "\u00c9a\x85b!\rq", "q", " \t"]
    langs, held = pa.array(["en"] * len(texts)), Bitmap(np.full(1, -1).view(np.uint64))
    rows = lambda k, wanted=None: Counter({r["phrase"]: r["m"] for b in phrases.phrases_of(langs, pa.array(texts), np.ones(len(texts), np.int64), k, None, wanted=wanted) for r in b.to_pylist()})
    assert rows(1) == rows(1, held) == Counter(["ab", "cd", "e", "f", "x", "y", "z", "\u00c9a\x85b", "q", "q"])
    assert rows(2) == rows(2, held) == Counter(["cd e", "e f", "y z"]) and rows(3) == Counter(["cd e f"])
    assert not rows(1, Bitmap(np.zeros(1, np.uint64)))


def test_counts_are_exact_whatever_the_bitmaps_take_in(spark, monkeypatch):
    rows = corpus()
    full = lambda *_: spark.sparkContext.broadcast(Bitmap(np.full(1, -1).view(np.uint64)))
    monkeypatch.setattr(phrases, "bitmap", full)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(df, 4, 20).collect())) == brute(rows, 4, 20, 1000, 100, 2000)
