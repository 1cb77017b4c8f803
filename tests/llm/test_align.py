"""Alignment of two tokenizers against brute force with the plain libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from pyspark.accumulators import AccumulatorParam

from quirelake.llm import align

pytest.importorskip("public_tokenizers")
PATHS = align.vocabularies()


class Most(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(parts):
    out, at = [], 0
    for i, b in parts:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def tokens(text, plain):
    a, b = plain
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    e = a.encode(" " + text, add_special_tokens=False)
    of_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in e.ids]
    of_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x[1] for x in of_a) != want or b"".join(x[1] for x in of_b) != want:
        return [], []
    return spans(of_a), spans(of_b)


def brute(rows, plain):
    each, count = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text, plain) if text else ([], [])
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        count.update(links)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, at = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if at < x[2] <= e) for side in (a, b)))
            at = e
        each.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return sorted([(i, na, nb, ng, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), sha(g)) for i, na, nb, ng, ls, g in each], key=repr)


ODD = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "   x   y   ", "a\tb\n\nc", "<|endoftext|> </s> <unk> <0x41>", "▁x", "x▁y z", "naïve café 中文书 日本語 🙂🙃 ﬁ ½ Å", "\x00 \x01 nul", "a b 　 c", "1234567890 3.14", "don't we'll I've", "x" * 300, "ab " * 200, "\r\n\x0b\x0c", "é" * 40, "é å", "‍ ​ zero", "a ▁ b", "﻿bom", "𝔘𝔫𝔦 𐍈"]


def corpus(n):
    rng = random.Random(11)
    parts = ["the", "and", "tion", "Über", "ß", "中", "🙂", " ", "  ", "\n", "\t", ".", ",", "'s", "42", "é", "quick", "-", " ", "_"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(ODD + texts)] + [(3, "the same"), (3, "the same"), (None, "the same"), (None, None)]


def test_units_give_the_ids_of_whole_texts(plain):
    t = align.table(*PATHS)
    assert t.cuts
    for _, text in corpus(300):
        if not text:
            continue
        of_a, of_b = tokens(text, plain)
        units = t.units(text)
        assert "".join(units) == " " + text
        pack = t.pack([1], [text]).to_pylist()[0]
        seq = [pack["units"][i] for i in pack["docs"][0]["seq"]]
        assert [i for u in seq for i in u["ids_a"]] == [x[0] for x in of_a], text
        assert [i for u in seq for i in u["ids_b"]] == [x[0] for x in of_b], text
        assert all(u["ends_a"][-1] == u["ends_b"][-1] for u in seq)


def test_alignment_matches_brute_force(spark, plain, monkeypatch):
    monkeypatch.setattr(align, "FREQUENT", 20)
    rows = corpus(150)
    df = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, row string, pair int").repartition(3)
    for size, few in ((1, 64), (200, 0), (1 << 22, 64), (1 << 22, 5)):
        monkeypatch.setattr(align, "FEW", few)
        found = align.scored(df, *PATHS, size=size)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, plain)
    assert align.scored(df.limit(0), *PATHS).count() == 0


def test_groups_and_links_of_units(spark, plain):
    rows = [(i, t) for i, t in corpus(60) if i is not None]
    found = {r.doc_id: r.units for r in align.aligned(spark.createDataFrame(rows[:80], "doc_id long, text string"), *PATHS).collect()}
    for i, text in rows[:80]:
        a, b = tokens(text, plain) if text else ([], [])
        links, groups, at_a, at_b = set(), [], 0, 0
        for u in found[i]:
            links |= {(at_a + x.a, at_b + x.b) for x in u.links}
            groups += u.groups
            at_a, at_b = at_a + sum(len(g.a) for g in u.groups), at_b + sum(len(g.b) for g in u.groups)
        assert links == {(p, q) for p, x in enumerate(a) for q, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]}
        assert [k for g in groups for k in g.a] == [x[0] for x in a] and [k for g in groups for k in g.b] == [x[0] for x in b]


def test_a_full_table_of_units(plain, monkeypatch):
    monkeypatch.setattr(align, "UNITS", 8)
    t = align.Table(align.ByteLevel(PATHS[0]), align.Pieces(PATHS[1]))
    for _, text in corpus(100):
        if text and "▁" not in text:
            pack = t.pack([1, 2], [text, text]).to_pylist()[0]
            assert [i for k in pack["docs"][1]["seq"] for i in pack["units"][k]["ids_b"]] == plain[1].encode(text)


def test_a_long_text(spark, plain):
    text = "Many words, naïve ones too. " * 40_000
    found = align.scored(spark.createDataFrame([(1, text), (2, "x" * 200_000)], "doc_id long, text string"), *PATHS).collect()
    n = {r.doc_id: r for r in found}
    assert n[1].n_a == len(plain[0].encode(" " + text).ids) and n[1].n_b == len(plain[1].encode(text)) and n[1].n_links == n[1].n_a + n[1].n_b - n[1].n_groups
    assert n[2].n_a == len(plain[0].encode(" " + "x" * 200_000).ids)


def test_fresh_units_go_to_tokenizers_in_bounded_steps(plain, monkeypatch):
    t = align.Table(align.ByteLevel(PATHS[0]), align.Pieces(PATHS[1]))
    steps = []
    for coder in t.coders:
        monkeypatch.setattr(coder, "encode", lambda units, f=coder.encode: steps.append((len(units), sum(map(len, units)))) or f(units))
    text = " ".join(f"word{i}, {'naïve' * (i % 40)}" for i in range(15_000))
    pack = t.pack([1], [text]).to_pylist()[0]
    assert max(n for n, _ in steps) <= 8192 and max(c for _, c in steps) < len(text) / 2
    assert [i for k in pack["docs"][0]["seq"] for i in pack["units"][k]["ids_a"]] == [x[0] for x in tokens(text, plain)[0]]


def test_a_pack_has_each_pair_once(spark, plain):
    rows = spark.createDataFrame([(i, "the same words, and again the same words " * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    (pack,) = align.packed(rows, *PATHS, kind=align.Linked).collect()
    assert len(pack.pairs) == len(set(pack.pairs)) < 40 and sum(pack.weights) == sum(r.n_links for r in align.scored(rows, *PATHS).collect())


def test_packs_go_to_python_few_at_a_time(spark, plain, monkeypatch):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40_000))
    rows = spark.createDataFrame([(i, text()) for i in range(30)], "doc_id long, text string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes, answered = spark.sparkContext.accumulator([], Most()), align._answered

    def watched(frequent):
        def run(batches):
            def seen():
                for b in batches:
                    sizes.add([b.nbytes])
                    yield b

            yield from answered(frequent)(seen())

        return run

    monkeypatch.setattr(align, "_answered", watched)
    assert align.scored(rows, *PATHS, size=1 << 17).count() == 30
    assert len(sizes.value) > 1 and max(sizes.value) < 3 * (8 << 20)
    assert sum(sizes.value) > 3 * (8 << 20)
