"""Collocations: phrases of 2 to 5 words that occur far more often than their parts would together, by language.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and these into words at spaces and tabs, by NumPy on a batch's bytes; Arrow gives equal words one code, so that hashes are taken of distinct words alone.

Phrases are counted in two rounds, first those of one and two words, then longer ones, and each round twice. First by 64-bit hash: a task sums the hashes of up to KEYS phrases before they leave it, as an array for each bucket of hashes, so that a hot phrase
comes to its counter once for all of them and Spark moves arrays, not rows; then they are summed over the corpus. A phrase is no more frequent than its hash, so a bitmap of the hashes that reach the least frequency (64 MB at most; it takes in a few others, never misses one)
has all phrases that can. Only these are written out as words and summed exactly, by language and phrase, whatever hashes they share. Both sums spill as other aggregations of Spark do.

The second round reads runs: the longest parts of pieces whose neighbouring words are all pairs of the bitmap, at least three words, equal ones summed. Each frequent phrase of three words or more lies within them. Phrases go through a task in blocks of at most BLOCK words with an overlap.

A candidate cut after k words asks for the counts of its two parts. Requests travel by hash of language and part to where its count is, meet it in a join whose hot parts adaptive execution splits, and the answers come back by candidate. A part of a candidate is
as frequent as the candidate, so each request finds its count. Scores are floor(scale * a * n / (l * r)) in decimals of 38 digits. A candidate goes if a longer one that holds its words is as frequent (`share` per cent of it); the longer ones
say so themselves, by one row for each phrase within them, reduced by partial maxima. Candidates of a language are ranked in SHARES shares first, of which `top` rows each go on, so that no task ranks a whole language.

Nulls and edge cases. A null text has no words; a null language is 'und', together with documents of language 'und'. Repeated rows count each. A text without words adds nothing. A language without candidates has no rows. Ties are broken by the phrase's
bytes. Counts up to 10^13 keep the arithmetic exact. An empty table gives an empty result. Columns other than text and language aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, drop, written

LONGEST, LEAST, SCALE, SHARE, TOP = 5, 100, 1000, 100, 2000
#: Words that a task turns into phrases at once, and hashes that it sums before they leave it.
BLOCK, KEYS = 1 << 19, 1 << 21
#: Buckets of hashes, which shuffle partitions share: many, so that these come out even.
BUCKETS = 1 << 12
#: Shares of a language's candidates that are ranked apart before what is left of them is ranked together.
SHARES = 64
#: What bytes are: 0 of a word, 1 between words, 2 between pieces. All bytes of other characters than these are of words.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")], _KIND[list(b".,;:!?\n\x0b\x0c\r")] = 1, 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
_SPACE = pa.scalar(" ", pa.large_string())
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, f long, key long"
#: Number of words that stands for runs.
RUN = -1


class Words:
    """The lower-cased words of texts in order: their distinct words, the code of each word among them, its text, and its piece by rising numbers."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        self.langs, texts = langs, texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        kind, starts = _KIND[data], ends[:-1] - ends[0]
        inner = kind == 0
        edge = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        # Words that meet where one text ends and the next begins.
        meet = np.unique(starts[(starts > 0) & (starts < len(data))])
        meet = meet[inner[meet] & inner[meet - 1]]
        if len(meet):
            edge = np.sort(np.concatenate([edge, meet, meet]))
        first, last = edge[::2].copy(), edge[1::2]
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(last - first, out=offsets[1:])
        flat = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_LOW[data[inner]])).dictionary_encode()
        self.distinct, self.codes = flat.dictionary, flat.indices.to_numpy()
        self.of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(first, np.append(starts, len(data)))))
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[first] + self.of.astype(np.int64)
        self.hashes = word_hashes(self.distinct)
        self.at_lang = word_hashes(langs)


def words_in(langs: pa.Array, texts: pa.Array, *more: np.ndarray) -> Iterator[tuple]:
    """Words of some megabytes of texts at a time, and their part of more."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // (8 * BLOCK))) + 1):
        if len(rows):
            a, n = int(rows[0]), len(rows)
            yield Words(langs.slice(a, n), texts.slice(a, n)), *(x[a : a + n] for x in more)


def texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece, m: the texts as they are, each once."""
    col = lambda name, null: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(null))
    return docs.select(col(lang_col, "und").alias("lang"), col(text_col, "").alias("piece"), F.lit(1).cast("long").alias("m"))


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a phrase of hash h with a word of hash w behind it."""
    x = (h ^ (h >> np.uint64(29))) * _MIX + w
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)


def phrase_keys(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Hash of each phrase in its language, the same as phrases in pieces have."""
    words = pc.split_pattern(phrases, " ")
    hashes, ends = word_hashes(words.flatten()), np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
    starts, out = np.concatenate([[0], ends[:-1]]).astype(np.int64), word_hashes(langs)
    for k in range(int((ends - starts).max(initial=0))):
        has = starts + k < ends
        out[has] = mixed(out[has], hashes[starts[has] + k])
    return out.view(np.int64)


def _grouped(keys: np.ndarray, m: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where each distinct one begins in it, and the sums of m (None: ones)."""
    order = np.argsort(keys)
    x = keys[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return order, at, np.diff(np.append(at, len(x))) if m is None else np.add.reduceat(m[order], at)


def phrases_in(words: Words, m: np.ndarray, k: int, known, wanted, block: int) -> Iterator[pa.RecordBatch]:
    langs, n_words = words.langs.dictionary_encode(), max(len(words.distinct), 1)
    lang = langs.indices.to_numpy()
    for at in range(0, len(words.codes), block):
        codes, piece, of = (x[at : at + block + k - 1] for x in (words.codes, words.piece, words.of))
        n = len(codes) - k + 1
        if n <= 0:
            continue
        start = np.flatnonzero(piece[:n] == piece[k - 1 :])
        if (known is not None or wanted is not None) and len(start):
            hashes, h = words.hashes[codes], words.at_lang[of]
            for j in range(k - 1):
                h = mixed(h[: n + k - 1 - j], hashes[j:])
            h = h[: n + 1]
            if known is not None:
                ok = known.has(h)
                start = start[ok[start] & ok[start + 1]]
            if wanted is not None:
                start = start[wanted.has(mixed(h[start], hashes[start + k - 1]))]
        if not len(start):
            continue
        # Language and words in one number; where that would pass 63 bits, by rank of what it holds so far.
        group, top = lang[of[start]].astype(np.int64), len(langs.dictionary)
        for j in range(k):
            if top * n_words >= 1 << 63:
                group = np.unique(group, return_inverse=True)[1]
                top = len(start)
            group, top = group * n_words + codes[start + j], top * n_words
        order, begins, sums = _grouped(group, m[of[start]])
        one = start[order[begins]]
        names = [words.distinct.take(pa.array(codes[one + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*names, _SPACE) if k > 1 else names[0]
        yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(of[one])), phrase.cast(pa.string()), pa.array(sums)], names=["lang", "phrase", "m"])


def phrases_of(langs: pa.Array, texts: pa.Array, m: np.ndarray, k: int, known, block: int = BLOCK, wanted=None) -> Iterator[pa.RecordBatch]:
    """lang, phrase, m of phrases of k words, summed within blocks of words. known is a Bitmap of the phrases of k - 1 words that may be part of one, wanted one of those of k words, None for all."""
    for words, some in words_in(langs, texts, m):
        yield from phrases_in(words, some, k, known, wanted, block)


def runs_in(words: Words, m: np.ndarray, known) -> Iterator[pa.RecordBatch]:
    h, of = words.hashes[words.codes], words.of
    pair = np.zeros(len(of) + 1, bool)  # whether a word and the next are known; none before the first
    pair[1:-1] = (words.piece[:-1] == words.piece[1:]) & known.has(mixed(mixed(words.at_lang[of[:-1]], h[:-1]), h[1:]))
    first, last = np.flatnonzero(pair[1:] & ~pair[:-1]), np.flatnonzero(pair[:-1] & ~pair[1:])
    first, last = first[last - first > 1], last[last - first > 1]
    if not len(first):
        return
    ends = np.cumsum(last - first + 1)
    at = np.repeat(first - np.concatenate([[0], ends[:-1]]), last - first + 1) + np.arange(ends[-1])
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), words.distinct.take(pa.array(words.codes[at])))
    table = pa.table({"lang": words.langs.take(pa.array(of[first])), "piece": pc.binary_join(lists, _SPACE).cast(pa.string()), "m": m[of[first]]})
    yield from table.group_by(["lang", "piece"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["lang", "piece", "m"]).combine_chunks().to_batches()


def runs_of(langs: pa.Array, texts: pa.Array, m: np.ndarray, known) -> Iterator[pa.RecordBatch]:
    """lang, piece, m: of each piece the longest runs of three words or more whose neighbouring words are all known pairs, equal ones summed. Longer frequent phrases lie within them."""
    for words, some in words_in(langs, texts, m):
        yield from runs_in(words, some, known)


def hashes_of(langs: pa.Array, texts: pa.Array, m: np.ndarray, sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Hashes of the phrases of so many words, one for each occurrence in a text, and m of its text, None for ones."""
    for words, some in words_in(langs, texts, m):
        once = bool((some == 1).all())
        for at in range(0, len(words.codes), BLOCK):
            piece, of = (x[at : at + BLOCK + sizes[-1] - 1] for x in (words.piece, words.of))
            w, h = words.hashes[words.codes[at : at + len(of)]], words.at_lang[of]
            for k in range(1, min(sizes[-1], len(of)) + 1):
                h = mixed(h[: len(w) - k + 1], w[k - 1 :])
                if k in sizes:
                    n = min(len(h), BLOCK)
                    whole = piece[:n] == piece[k - 1 : k - 1 + n]
                    yield h[:n][whole], None if once else some[of[:n][whole]]


def packed(keys: list[np.ndarray], m: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    """bucket, keys, sums: the distinct keys of each bucket and the sums of their m."""
    x = np.concatenate(keys)
    if all(each is None for each in m):
        x.sort()
        at = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
        x, sums = x[at], np.diff(np.append(at, len(x)))
    else:
        order, at, sums = _grouped(x, np.concatenate([np.ones(len(k), np.int64) if each is None else each for k, each in zip(keys, m)]))
        x = x[order[at]]
    bucket = ((x >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int32)
    at = np.flatnonzero(np.diff(bucket, prepend=np.int32(-1)))
    lists = [pa.ListArray.from_arrays(pa.array(np.append(at, len(x)), pa.int32()), pa.array(v)) for v in (x.view(np.int64), sums.astype(np.int64))]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), *lists], names=["bucket", "keys", "sums"])


def _hash(sizes: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, m, n = [], [], 0
        for b in batches:
            for x, each in hashes_of(b.column(0), b.column(1), b.column(2).to_numpy(), sizes):
                keys.append(x)
                m.append(each)
                n += len(x)
                if n >= KEYS:
                    yield from packed(keys, m)
                    keys, m, n = [], [], 0
        if n:
            yield from packed(keys, m)

    return run


def _spell(sizes: range, held):
    """lang, words, phrase, m: phrases of so many words that a bitmap holds; with words 0 the number of words of a language, with words RUN runs for longer phrases, both in the first round alone. held has the Bitmap of each number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
            for r in rows:
                yield pa.RecordBatch.from_arrays([r.column(0), pa.array(np.full(len(r), k, np.int32)), r.column(1), r.column(2)], names=["lang", "words", "phrase", "m"])

        for b in batches:
            for words, m in words_in(b.column(0), b.column(1), b.column(2).to_numpy()):
                for k in sizes:
                    yield from named(phrases_in(words, m, k, held[k - 1].value if k - 1 in held else None, held[k].value, BLOCK), k)
                if 1 in sizes:
                    yield from named(runs_in(words, m, held[2].value), RUN)
                    n = pa.table({"lang": words.langs, "n": m * np.bincount(words.of, minlength=len(m))}).group_by("lang", use_threads=False).aggregate([("n", "sum")]).filter(pc.field("n_sum") > 0)
                    yield from named(n.select(["lang"]).append_column("phrase", pa.array([""] * len(n), pa.string())).append_column("m", n["n_sum"]).combine_chunks().to_batches(), 0)

    return run


def counts(parts: DataFrame, sizes: range, held: dict, least: int) -> DataFrame:
    """lang, words, phrase, f of the phrases in parts (lang, piece, m) of so many words that occur so often; in the first round, of one and two words, the sums of runs and of all words of a language, too. Adds the bitmaps of these numbers of words to held."""
    rows = parts.mapInArrow(_hash(sizes), "bucket int, keys array<long>, sums array<long>").repartition("bucket")
    keys = rows.select("bucket", F.inline(F.arrays_zip("keys", "sums"))).toDF("bucket", "key", "m")
    often = written(keys.groupBy("bucket", "key").agg(F.sum("m").alias("f")).where(F.col("f") >= least).select("key"), "keys")
    held |= dict.fromkeys(sizes, bitmap(often, "key"))
    drop(often)
    found = parts.mapInArrow(_spell(sizes, held), "lang string, words int, phrase string, m long").groupBy("lang", "words", "phrase").agg(F.sum("m").alias("f"))
    return written(found.where((F.col("words") <= 0) | (F.col("f") >= least)), "phrases", "words")


def frequent_phrases(parts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the phrases of 1, 2, ... words that occur so often, and n, the words of each language."""
    held: dict = {}
    short = counts(parts, range(1, 3), held, least)
    of = lambda t, k: t.where(F.col("words") == k).select("lang", "phrase", "f")
    long = counts(of(short, RUN).toDF("lang", "piece", "m"), range(3, longest + 1), held, least)
    for b in set(held.values()):
        b.unpersist()
    return [of(short if k < 3 else long, k) for k in range(1, longest + 1)], of(short, 0).select("lang", F.col("f").alias("n"))


def scored(tables: list[DataFrame], n: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, phrase, words (an array), a, l, r, n, score: each candidate by its lowest-scoring cut."""
    every = tables[0].select("lang", "phrase", "f")
    for t in tables[1:]:
        every = every.unionByName(t.select("lang", "phrase", "f"))
    cands = tables[1].select("lang", "phrase", "f")
    for t in tables[2:]:
        cands = cands.unionByName(t.select("lang", "phrase", "f"))
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    asked = cands.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), cut)
    side = lambda i, part: F.struct(F.lit(i).alias("side"), F.array_join(part, " ").alias("part"))
    first, rest = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    asked = asked.select("lang", "phrase", "a", "k", F.explode(F.array(side(0, first), side(1, rest))).alias("x")).select("lang", "phrase", "a", "k", "x.*")
    answers = asked.join(every.withColumnRenamed("phrase", "part"), ["lang", "part"])
    cuts = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    # The languages are the label values of the corpus; adaptive execution broadcasts n if it is small.
    cuts = cuts.join(n, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    product = (F.lit(scale).cast("decimal(6,0)") * F.col("a").cast("decimal(14,0)") * F.col("n").cast("decimal(14,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", product).withColumn("under", (big("l") * big("r")).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    low = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return low.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def held_by_longer(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, longer: for phrases within longer candidates, the highest count of these."""
    out = None
    for k, t in enumerate(tables[2:], 3):
        words = F.split("phrase", " ", -1)
        within = F.array(*[F.array_join(F.slice(words, i + 1, size), " ") for size in range(2, k) for i in range(k - size + 1)])
        rows = t.select("lang", "f", F.explode(within).alias("phrase"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, scale: int = SCALE, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language. longest is 3 at least."""
    tables, n = frequent_phrases(texts(docs, text_col, lang_col), longest, least)
    rows = scored(tables, n, scale).join(held_by_longer(tables), ["lang", "phrase"], "left")
    rows = rows.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "share"], ["lang"]):
        rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
p AS (SELECT lang, trim(unnest(ps), ' ' || chr(9)) AS piece FROM d),
w AS (SELECT lang, regexp_split_to_array(piece, '[\\x20\\x09]+') AS ws, count(*) AS m FROM p WHERE piece <> '' GROUP BY ALL),
t AS (SELECT lang, sum(m * len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, m, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS (SELECT lang, ws, m, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k FROM g),
f AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, sum(m) AS f FROM h GROUP BY ALL HAVING sum(m) >= 100),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, k AS len, f AS a FROM f WHERE k > 1),
x AS (SELECT *, unnest(range(1, len)) AS k FROM c),
s AS (SELECT x.lang, x.phrase, x.len, x.a, x.k, l.f AS l, r.f AS r, t.n, 1000::HUGEINT * x.a * t.n // (l.f::HUGEINT * r.f) AS score FROM x JOIN t ON t.lang = x.lang
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:x.k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
z AS (SELECT lang, a, ws, len, unnest(range(2, len)) AS size FROM c WHERE len > 2),
y AS (SELECT lang, a, ws, size, unnest(range(1, len - size + 2)) AS i FROM z),
o AS (SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM y GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE b.o = 1 AND (o.longer IS NULL OR 100 * o.longer < 100 * b.a)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM k WHERE rank <= 2000
"""
