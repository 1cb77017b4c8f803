"""Alignment of two tokenizers over whole texts: the byte ranges at which both end a token, the groups between these, and all links of tokens that overlap.

A is a byte-level BPE of the tokenizers library over space + text, B a byte-fallback BPE of sentencepiece, which adds that space itself.
A text is cut into units before each single space between two characters other than white space: no match of A's pattern and no piece of B's vocabulary crosses such a place (the vocabulary is searched for one that could when it is
loaded; texts are one unit then), so both end a token there and a unit's ids are those of the whole text. Documents of about PACK characters make a pack: a row with its distinct units, each once, and its documents as sequences of units.
A worker keeps a bounded table of units that it has met, and tokenises fresh ones CHUNK at a time; A takes units of up to FEW characters end to end, as a text of its own, and the bytes say where each ends.

Distinct ends of both sides close one stretch each that lies in one token of A and one of B; two stretches never share both, so these are the links. Ends of both cut a unit into groups. An Arrow function works these out for all fresh
units at once (Linked); aligned() returns groups and links as they are, by higher-order functions.

Links are counted by id pair over all documents, from a pack's distinct pairs weighted with their occurrences. Of the pairs, the FREQUENT most frequent ones are broadcast (a fixed number) and answer most links where they
stand; the others, none of which can be hot, meet their counts in a join and go back to their documents.

Nulls and edge cases. Null and empty texts, and texts that A's or B's tokens don't give back byte by byte (such as ones with U+2581), have no tokens: empty arrays, zeros, and '' for the digest. Special tokens' strings are ordinary text.
Each row is a document of its own, whatever its id; rows that repeat count each. A long text is in one pack, with a number for each of its units; a long text without any place to cut is one unit. An empty table gives an empty result. Columns other than
id and text aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHITE, byte_characters
from .common import written

#: Characters of a pack, units that a worker keeps before it begins anew, pairs that are broadcast, characters of units that are tokenised end to end, how many of these at once, and units between two steps of a tokenizer.
PACK, UNITS, FREQUENT, FEW, RUN, CHUNK = 1 << 20, 150_000, 1 << 16, 64, 128, 1 << 13
_UNIT = re.compile(f"[{WHITE}]*+[^{WHITE}]++(?:(?! [^{WHITE}])[{WHITE}]++[^{WHITE}]++)*+(?:[{WHITE}]++\\Z)?+|[{WHITE}]+")
_PLAIN = re.compile(f" [^{WHITE}](?:.*[^{WHITE}])?", re.S)
_LIST = pa.list_(pa.int32())
_SIDES = ("ids_a", "ends_a", "ids_b", "ends_b")
_WORD = pa.struct([*((c, _LIST) for c in _SIDES), ("n", pa.int64())])
_DOC = pa.struct([("doc_id", pa.int64()), ("seq", _LIST)])
PACKS = "units array<struct<ids_a:array<int>,ends_a:array<int>,ids_b:array<int>,ends_b:array<int>,n:bigint>>, docs array<struct<doc_id:bigint,seq:array<int>>>"
#: A pack's documents, their units' numbers end to end (seq), the links of its units end to end as places in its distinct pairs, and how often each pair occurs in it.
LINKS = "doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, n_units array<int>, seq array<int>, n_links array<int>, links array<int>, pairs array<bigint>, weights array<bigint>"
ANSWERS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, rest array<struct<pair:bigint,n:bigint>>"
LINK_COLUMNS = [c.split()[0] for c in LINKS.split(", ")]
ANSWER_COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]
_REST = pa.struct([("pair", pa.int64()), ("n", pa.int64())])


class Coder:
    """A tokenizer of units that begin with a space, with each token's bytes; cuts says whether no token crosses the places between units."""

    bytes: list[bytes]
    cuts = True
    #: Whether units are tokenised faster end to end than one by one.
    runs = False

    def measured(self) -> None:
        self.lengths = np.array([len(b) for b in self.bytes], np.int32)


class ByteLevel(Coder):
    """A: a byte-level file of the tokenizers library."""

    runs = True

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in t)
        # The library's own pattern of byte-level splitting begins a match at each such space.
        self.cuts = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.measured()

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class Pieces(Coder):
    """B: a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.cuts = not any(re.search("[^▁]▁", n) for n in names)
        self.measured()

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode([u[1:] for u in units], num_threads=1)


def _listed(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), values)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    at, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(lengths)
    return at[ends] - at[ends - lengths]


class _Flat:
    """Lists of integers end to end."""

    def __init__(self) -> None:
        self.values, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and lengths of the lists of these numbers."""
        lengths = self.starts[codes + 1] - self.starts[codes]
        return self.values[_ragged(self.starts[codes], lengths)], lengths


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


@dataclass
class Side:
    """Ids of units end to end, how many each unit has, and where each ends, in bytes from the first unit's start."""

    ids: np.ndarray
    n: np.ndarray
    ends: np.ndarray


class Table:
    """Ids and byte ends of units under both tokenizers, each unit tokenised once while it is kept."""

    def __init__(self, a: Coder, b: Coder) -> None:
        self.coders, self.cuts = (a, b), a.cuts and b.cuts
        self.forget()

    def forget(self) -> None:
        self.index = _Numbers()
        self.whole = np.zeros(0, bool)
        self.flat = {c: _Flat() for c in _SIDES}

    def units(self, text: str) -> list[str]:
        """The units of space + text."""
        return _UNIT.findall(" " + text) if self.cuts else [" " + text]

    def codes(self, units: list[str]) -> np.ndarray:
        """A number for each unit, valid until the next call; self.whole says which ones both tokenizers give back byte by byte."""
        if len(self.index) > UNITS:
            self.forget()
        known = len(self.index)
        codes = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        fresh = [*islice(self.index, known, None)]
        for i in range(0, len(fresh), CHUNK):
            self._meet(fresh[i : i + CHUNK])
        return codes

    def _meet(self, units: list[str]) -> None:
        data = [u.encode() for u in units]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        both = [self._tokens(c, units, data, sizes) for c in self.coders]
        whole = both[0][2] & both[1][2]
        self.whole = np.concatenate([self.whole, whole])
        sides = []
        for coder, (ids, n, _) in zip(self.coders, both):
            ids, n = ids[np.repeat(whole, n)], np.where(whole, n, 0)  # no document has the other units
            sides.append(Side(ids, n, np.cumsum(coder.lengths[ids], dtype=np.int64)))
        self.keep(*sides, np.cumsum(np.where(whole, sizes, 0)))

    def _tokens(self, coder: Coder, units: list[str], data: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units end to end, how many each has, and whether the unit is what they stand for."""
        if coder.runs and self.cuts:
            texts, run = [], []
            for u in units:
                plain = len(u) <= FEW and _PLAIN.fullmatch(u)
                if run and (not plain or len(run) == RUN):
                    texts.append("".join(run))
                    run = []
                run.append(u) if plain else texts.append(u)
            ids = np.fromiter(chain.from_iterable(coder.encode([*texts, "".join(run)] if run else texts)), np.int32)
            ends, stops = np.cumsum(coder.lengths[ids], dtype=np.int64), np.cumsum(sizes)
            last = np.searchsorted(ends, stops)
            if len(ends) and ends[-1] == stops[-1] and (ends[last] == stops).all() and b"".join(map(coder.bytes.__getitem__, ids.tolist())) == b"".join(data):
                return ids, np.diff(last + 1, prepend=0), np.ones(len(units), bool)
        each = coder.encode(units)
        n = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.int32, int(n.sum()))
        whole = _sums(coder.lengths[ids].astype(np.int64), n) == sizes
        if not whole.all() or b"".join(map(coder.bytes.__getitem__, ids.tolist())) != b"".join(data):
            whole = np.fromiter((b"".join(map(coder.bytes.__getitem__, i)) == d for i, d in zip(each, data)), bool, len(each))
        return ids, n, whole

    def keep(self, a: Side, b: Side, stops: np.ndarray) -> None:
        """Takes in fresh units, which end at stops; those that aren't whole are empty."""
        starts = np.concatenate([[0], stops[:-1]])
        for side, name in ((a, "a"), (b, "b")):
            self.flat[f"ids_{name}"].add(side.ids, side.n)
            self.flat[f"ends_{name}"].add((side.ends - np.repeat(starts, side.n)).astype(np.int32), side.n)

    def dealt(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts end to end and how many each text has; texts with a unit that isn't whole have none."""
        each = [self.units(t) if t else [] for t in texts]
        n = np.fromiter(map(len, each), np.int64, len(each))
        codes = self.codes([*chain.from_iterable(each)])
        good = _sums(~self.whole[codes], n) == 0
        return codes[np.repeat(good, n)], np.where(good, n, 0)

    def pack(self, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        """One row of PACKS."""
        codes, lengths = self.dealt(texts)
        used, seq, n = np.unique(codes, return_inverse=True, return_counts=True)
        words = pa.StructArray.from_arrays([*(_listed(*self.flat[c].take(used)) for c in _SIDES), pa.array(n, pa.int64())], fields=list(_WORD))
        docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), _listed(seq.astype(np.int32), lengths)], fields=list(_DOC))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(docs)], docs)], names=["units", "docs"])


class Linked(Table):
    """A table that keeps of units their links by id pair and their groups as text, instead of ids and ends."""

    def __init__(self, a: Coder, b: Coder) -> None:
        most = max(len(a.bytes), len(b.bytes))
        self.digits = np.array([*map(str, range(most))], f"S{len(str(most))}").view(np.uint8).reshape(most, -1)
        self.digits = np.pad(self.digits, ((0, 0), (0, 1)))  # a place for what comes behind
        self.shown = (self.digits > 0).sum(axis=1)
        super().__init__(a, b)

    def forget(self) -> None:
        super().forget()
        self.pairs, self.texts, self.links = _Numbers(), [], _Flat()
        self.sizes = np.zeros((3, 0), np.int64)  # tokens of A, of B, groups

    def keep(self, a: Side, b: Side, stops: np.ndarray) -> None:
        ends = np.union1d(a.ends, b.ends)
        pairs = (a.ids[np.searchsorted(a.ends, ends)].astype(np.int64) << 32) + b.ids[np.searchsorted(b.ends, ends)]
        distinct, at = np.unique(pairs, return_inverse=True)
        numbers = np.fromiter(map(self.pairs.__getitem__, distinct.tolist()), np.int32, len(distinct))
        within = lambda x: np.diff(np.searchsorted(x, stops, "right"), prepend=0)
        self.links.add(numbers[at], within(ends))
        both = np.intersect1d(a.ends, b.ends, assume_unique=True)
        self.sizes = np.concatenate([self.sizes, [a.n, b.n, within(both)]], axis=1)
        self.texts += self._groups(a, b, both)

    def _groups(self, a: Side, b: Side, both: np.ndarray) -> list[bytes]:
        """Of each unit its groups as text: ids of A and B with commas, a bar between, a semicolon behind each group."""
        # Tokens up to the end of each group, and the place of each token when B's of a group come behind A's.
        of_a, of_b = (np.searchsorted(x.ends, both, "right") for x in (a, b))
        n_a, n_b = np.diff(of_a, prepend=0), np.diff(of_b, prepend=0)
        place_a = np.arange(len(a.ids)) + np.repeat(of_b - n_b, n_a)
        place_b = np.arange(len(b.ids)) + np.repeat(of_a, n_b)
        ids, behind = np.empty(len(a.ids) + len(b.ids), np.int32), np.full(len(a.ids) + len(b.ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a.ids, b.ids
        behind[of_a + (of_b - n_b) - 1] = ord("|")
        behind[of_a + of_b - 1] = ord(";")
        rows, shown = self.digits[ids], self.shown[ids]
        rows[np.arange(len(ids)), shown] = behind
        text = rows[rows > 0].tobytes()
        upto = np.concatenate([[0], np.cumsum(shown + 1)])[np.cumsum(a.n + b.n)].tolist()
        return [text[i:j] for i, j in zip([0, *upto], upto)]

    def pack(self, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        """One row of LINKS."""
        codes, n_units = self.dealt(texts)
        used, seq, n = np.unique(codes, return_inverse=True, return_counts=True)
        links, n_links = self.links.take(used)
        weights = np.bincount(links, np.repeat(n, n_links), len(self.pairs)).astype(np.int64)
        own = np.flatnonzero(weights)
        place = np.zeros(len(weights), np.int32)
        place[own] = np.arange(len(own))
        sizes = [_sums(x[codes], n_units) for x in self.sizes]
        one, stop, digests = codes.tolist(), 0, []
        for k in n_units.tolist():
            start, stop = stop, stop + k
            text = b"".join(map(self.texts.__getitem__, one[start:stop]))
            digests.append(hashlib.sha256(memoryview(text)[:-1]).hexdigest() if k else "")
        pairs = np.fromiter(self.pairs, np.int64, len(self.pairs))[own]
        columns = [pa.array(ids, pa.int64()), *sizes, pa.array(digests, pa.string()), n_units.astype(np.int32), seq.astype(np.int32), n_links.astype(np.int32), place[links], pairs, weights[own]]
        row = [pa.ListArray.from_arrays([0, len(c)], c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
        return pa.RecordBatch.from_arrays(row, names=LINK_COLUMNS)


@lru_cache(maxsize=2)
def _coders(path_a: str, path_b: str) -> tuple[Coder, Coder]:
    return ByteLevel(path_a), Pieces(path_b)


@lru_cache(maxsize=2)
def table(path_a: str, path_b: str, kind: type[Table] = Table) -> Table:
    return kind(*_coders(path_a, path_b))


def _packed(path_a: str, path_b: str, size: int, kind: type[Table]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = table(path_a, path_b, kind)
        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py()), texts.append(t.as_py())
                chars += len(texts[-1] or "")
                if chars >= size:
                    yield units.pack(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield units.pack(ids, texts)
        units.forget()  # the worker lives on for other stages

    return run


def packed(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", size: int = PACK, kind: type[Table] = Table) -> DataFrame:
    """PACKS, or LINKS where kind is Linked, over all rows of docs."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_packed(path_a, path_b, size, kind), LINKS if kind is Linked else PACKS)


def _struct(**fields: Column) -> Column:
    """A struct whose names hold within lambdas, too."""
    return F.named_struct(*chain.from_iterable((F.lit(k), v) for k, v in fields.items()))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SIDE, _PLACE = 1 << 32, (1 << 31) - 1
_end = lambda x: F.shiftright(x, 33)
_place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
_of_b = lambda x: x.bitwiseAND(F.lit(_SIDE)) != 0


def sorted_ends(u: Column) -> Column:
    """Ends of both sides of a unit in order: the end, a bit for B, the place. Of equal ends A's comes first."""
    of_a = F.transform(u["ends_a"], lambda e, i: F.shiftleft(e.cast("long"), 33) + i)
    of_b = F.transform(u["ends_b"], lambda e, i: F.shiftleft(e.cast("long"), 33) + i + F.lit(_SIDE))
    return F.sort_array(F.concat(of_a, of_b))


def groups_of(u: Column, s: Column) -> Column:
    """array<struct<a, b>> of a unit with its sorted ends: the ids of each group."""
    # Where both end: the numbers of tokens of A and B up to there.
    bound = lambda x, j: F.when(_of_b(x), F.when(_end(F.get(s, j - 1)) == _end(x), _struct(a=j - _place(x), b=_place(x) + 1)))
    bounds = F.array_compact(F.transform(s, bound))

    def group(x: Column, k: Column, at: Column) -> Column:
        cut = lambda c: _let(F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1)[c]), lambda start: F.slice(u[f"ids_{c}"], start + 1, x[c] - start))
        return _struct(a=cut("a"), b=cut("b"))

    many = _let(bounds, lambda at: F.transform(at, lambda x, k: group(x, k, at)))
    # array_intersect gives the common ends; with one alone the unit is one group.
    return F.when(F.size(F.array_intersect(u["ends_a"], u["ends_b"])) == 1, F.array(_struct(a=u["ids_a"], b=u["ids_b"]))).otherwise(many)


def links_of(s: Column) -> Column:
    """array<struct<a, b>> of a unit's sorted ends: the places of each two tokens whose bytes overlap, in order."""
    of = lambda a, b: _struct(a=a, b=b)
    link = lambda x, j: F.when(~_of_b(x), of(_place(x), j - _place(x))).when(_end(F.get(s, j - 1)) != _end(x), of(j - _place(x), _place(x)))
    first = lambda x, j: F.when(_of_b(x) & (j == 0), of(j, _place(x))).otherwise(link(x, j))
    return F.array_compact(F.transform(s, first))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", size: int = PACK) -> DataFrame:
    """doc_id and, for each unit of the text, its groups (ids) and links (places of the tokens within the unit)."""
    both = lambda u: _let(sorted_ends(u), lambda s: _struct(groups=groups_of(u, s), links=links_of(s)))
    rows = packed(docs, path_a, path_b, id_col, text_col, size).select(F.transform("units", both).alias("units"), "docs")
    # Documents take their units before they become rows, so that no row carries its whole pack.
    each = F.transform("docs", lambda d: _struct(doc_id=d["doc_id"], units=F.transform(d["seq"], lambda i: F.get(F.col("units"), i))))
    return rows.select(F.explode(each).alias("d")).select("d.*")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions of a block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A pack is a row of some megabytes: few at a time are decoded and sent to Python, whatever their number in a task.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
ROWS = SMALL | {"spark.sql.parquet.columnarReaderBatchSize": "8"}


def judged_pairs(packs: DataFrame) -> DataFrame:
    """pair, count over all documents, best: whether it is the highest count of B's id, from LINKS."""
    each = packs.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.weights").alias("n"))
    counts = written(each.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    id_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("id_b")
    highest = counts.groupBy(id_b).agg(F.max("count").alias("highest"))
    # At most one row for each id of B's vocabulary.
    return counts.select("pair", "count", id_b).join(F.broadcast(highest), "id_b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _answered(frequent):
    """Documents of LINKS with their sums over links whose pairs are broadcast (sorted pairs, counts, best), and in rest their other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = frequent.value
        for batch in batches:
            for i in range(batch.num_rows):
                x = {n: batch.column(n)[i].values for n in batch.schema.names}
                seq, n_units, links, n_links, pairs = (x[n].to_numpy() for n in ("seq", "n_units", "links", "n_links", "pairs"))
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                met = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                total = lambda values: _sums(_sums(values[links], n_links)[seq], n_units)
                sums = [total(np.where(met, c[at], 0)) if len(known) else np.zeros(len(n_units), np.int64) for c in (best, counts)]
                # The other pairs of each document with their occurrences.
                others = np.where(met[links], 0, 1)
                own, starts = links[others > 0], np.cumsum(_sums(others, n_links)) - _sums(others, n_links)
                each = _sums(others, n_links)[seq]
                doc = np.repeat(np.repeat(np.arange(len(n_units)), n_units), each)
                key, n = np.unique(doc * max(len(pairs), 1) + own[_ragged(starts[seq], each)], return_counts=True)
                doc, pair = np.divmod(key, max(len(pairs), 1))
                rest = pa.StructArray.from_arrays([pa.array(pairs[pair]), pa.array(n, pa.int64())], fields=list(_REST))
                rest = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(n_units) + 1)).astype(np.int32), rest)
                all_links = _sums(n_links.astype(np.int64)[seq], n_units)
                yield pa.RecordBatch.from_arrays([*(x[n] for n in ("doc_id", "n_a", "n_b", "n_groups")), pa.array(all_links), *map(pa.array, sums), x["groups_sha256"], rest], names=ANSWER_COLUMNS)

    return run


def scored(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", size: int = PACK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and over the links of each document n_best and count_sum."""
    spark = docs.sparkSession
    with _settings(spark, SMALL):
        packs = written(packed(docs, path_a, path_b, id_col, text_col, size, Linked), "packs")
    pairs = written(judged_pairs(packs), "judged")
    most = pairs.orderBy(F.desc("count"), "pair").limit(FREQUENT).toArrow().sort_by("pair")
    frequent = spark.sparkContext.broadcast(tuple(most.column(c).cast(pa.int64()).to_numpy() for c in ("pair", "count", "best")))
    with _settings(spark, ROWS):
        found = written(packs.drop("weights").mapInArrow(_answered(frequent), ANSWERS).withColumn("row", F.monotonically_increasing_id()), "found")
    others = found.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(pairs, "pair")
    others = others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("count")).alias("c"))
    more = lambda own, add: (F.col(own) + F.coalesce(add, F.lit(0))).alias(own)
    return found.join(others, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "b"), more("count_sum", "c"), "groups_sha256")


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabularies())
