"""Near copies by shingle similarity, found through wide SimHash fingerprints and the Gray-order index.

Two texts are near copies if the sets of their word shingles (five words) have a Jaccard similarity of 0.8 or more. Near copies are linked, linked texts form groups.

How links are found. Texts with equal shingle sets are one class. Two rounds follow; the first joins most near copies cheaply, the second finds every link between the groups of the first, so that no group is
split and none is false.

First round. A class has a SimHash of WORDS * 64 bits of its set; at similarity 0.8 two sets differ in some 15 % of the bits (the angle of the
sets, as a share of a half turn). That is too much for blocks of which one must agree, so upper nodes hold the classes that agree in a chosen set of bits: `tables` sets of `bits` bits each, so many that a pair at 0.8 shares
a node with probability RECALL (more similar pairs nearly always). More classes take more bits, so that chance doesn't fill the nodes, and so more tables. In a node the index of simhash.GrayIndex (Gray order, patterns
shared by groups, groups pruned by accumulated differences) gives the pairs within DISTANCE bits. Of these a node passes on a minimum spanning forest, closest pairs first, never all pairs. Last, the similarity of each link
is computed exactly from the sets, and links under 0.8 go. A true link is missed here where no node shares it, where the fingerprints differ in over DISTANCE bits, or where a forest prefers a closer pair that then fails.

Second round. All classes put their shingles in one order, rarest first as a sample of SAMPLE documents has it, then by hash. Of two sets as similar as asked, the first n - ceil(0.8 n) + 1 shingles of each (n: its size) share one at
least, whatever the order is. So the classes that hold a shingle among these share it, and the buckets of all shingles whose least group of the first round is the same are one bucket: texts with much in common meet in few buckets, once
in each, not once for each shingle. All pairs of a bucket from two groups are compared, whatever its size, and a pair goes on unless it can't be similar: by the sizes, or by parities of the numbers of hashed shingles in cells (no more
of them differ than shingles do), in PARITY words first and then in two to four cells a shingle, which leave little but pairs within some hundredths of the similarity asked for. So what a bucket gives grows with the links, not with the
square of its size. What goes on is checked exactly as before. The sample and the order bear on speed alone.

Large nodes. A node of over LARGE members is dealt out in parts by hash; each part gives its forest and one leader a tree, and the leaders form the node anew. When leaders stop getting fewer by half, the parts
are compared pair by pair, each pair in a task of its own. Buckets of over LARGE members are compared in that way at once.

What is moved. Keys of nodes and shingles of prefixes are counted first; only classes in nodes of two or more, or with shingles of two groups or more, go on, found by a bitmap of bounded size (common.Bitmap) that is broadcast. Shingle sets are made
only for classes with a link to check; a class keeps about a fifth of its set for the second round. Of the texts themselves, only those of groups of two or more rows are shuffled at the end, again by a bitmap; all others are passed on where they are read.

Nulls and edge cases. A null or empty text, or one without words, has an empty set; all such texts are one group. A text of fewer words than a shingle is one shingle. Of each group the row with the least id stays, nulls last,
then the one with the least hash of its columns; of rows equal in all columns one stays. Columns may have any names and types but maps. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, drop, written
from .components import connected_components
from .simhash import GrayIndex, bit_sums, majority, shingle_blocks

WIDTH, WORDS, SIMILARITY, RECALL = 5, 4, 0.8, 0.92
#: Members of a node or bucket from which on it is dealt out.
LARGE = 2000
#: Documents that show which shingles are frequent, and cells of the table of their counts.
SAMPLE, CELLS = 4096, 1 << 22
#: Words of parities that are compared first, and words at most of the wide ones.
PARITY, WIDE = 4, 512
#: Odd numbers that make a hash into WORDS independent ones.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
FP = [f"f{i}" for i in range(WORDS)]
_FP = ", ".join(f"{f} long" for f in FP)
ODD = [f"p{i}" for i in range(PARITY)]
_ODD_WORDS = ", ".join(f"{p} long" for p in ODD)


def share_of_bits(similarity: float) -> float:
    """Share of the bits in which SimHashes of two equally large sets of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bit_distance(similarity: float = SIMILARITY, bits: int = 64 * WORDS) -> int:
    """Bits in which all but some 1 % of the pairs of that similarity differ at most."""
    p = share_of_bits(similarity)
    return math.floor(bits * p + 2.3 * math.sqrt(bits * p * (1 - p)))


def tables(classes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> np.ndarray:
    """Masks (tables x WORDS) of the upper nodes for so many classes: a class meets one other by chance in a sixteenth of its nodes at most."""
    bits = max(20, math.ceil(math.log2(max(classes, 1))) + 4)
    agree = (1 - share_of_bits(similarity)) ** bits
    n = math.ceil(math.log(1 - recall) / math.log1p(-agree))
    rng = np.random.default_rng(7)
    out = np.zeros((n, 64 * WORDS), np.uint8)
    for row in out:
        row[rng.choice(64 * WORDS, bits, replace=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    found = [np.unique(h) for h in shingle_blocks((text or "").encode(), width)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))


def spread(x: np.ndarray, word: int) -> np.ndarray:
    """Other well-mixed hashes of hashes, for each word of the fingerprint."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD[word])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[(word + 1) % 4])
    return x ^ (x >> np.uint64(32))


def sketch_class(h: np.ndarray) -> int:
    """Name of the class of a shingle set: its hash, 0 for the empty set."""
    return (xxhash.xxh64_intdigest(h.tobytes()) or 1) if len(h) else 0


def sketch(h: np.ndarray) -> tuple[int, list[int]]:
    """Class and wide fingerprint of a shingle set."""
    return sketch_class(h), [majority(bit_sums(spread(h, w)), len(h)) for w in range(WORDS)]


_signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))


def least_overlap(size, similarity: float = SIMILARITY):
    """Least overlap of two sets of that similarity and that sum of sizes; a little less, for rounding."""
    return (similarity * size - 1e-6) / (1 + similarity)


def prefix(h: np.ndarray, frequent: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set (sorted hashes) in the common order, rarest first: two sets of that similarity share one of them at least."""
    n = len(h)
    rank = frequent[h & np.uint64(len(frequent) - 1)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    return h[np.argsort(rank, kind="stable")[: n - math.ceil(similarity * n - 1e-6) + min(n, 1)]]


def parities(h: np.ndarray, words: int = PARITY) -> np.ndarray:
    """Parity of the number of hashes in each of words * 64 cells (words: a power of two): of two sets no more cells differ than hashes."""
    cells = np.bincount((h >> np.uint64(24) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def wide_parities(h: np.ndarray) -> bytes:
    """parities() in two to four cells a hash, WIDE words at most."""
    return parities(h, min(WIDE, 1 << max(0, (2 * len(h) - 1).bit_length() - 6))).tobytes()


def cells_apart(wide: list[bytes], i: np.ndarray, j: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """In how many cells the wide parities i and j of each pair differ; the larger ones are folded to the cells of the others."""
    flat, words = np.frombuffer(b"".join(wide), np.uint64), np.array([len(x) // 8 for x in wide], np.int64)
    start, out = np.cumsum(words) - words, np.zeros(len(i), np.int64)

    def folded(x: np.ndarray, own: int, to: int) -> np.ndarray:
        return np.bitwise_xor.reduce(flat[start[x][:, None] + np.arange(own)].reshape(len(x), own // to, to), axis=1)

    for p, q in set(zip(words[i].tolist(), words[j].tolist())):
        at = np.flatnonzero((words[i] == p) & (words[j] == q))
        for k in np.array_split(at, 1 + len(at) * (p + q) // most):
            out[k] = np.bitwise_count(folded(i[k], p, min(p, q)) ^ folded(j[k], q, min(p, q))).sum(axis=1, dtype=np.int64)
    return out


def _cells(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array((shingle_set(t.as_py(), width) & np.uint64(CELLS - 1)).astype(np.int32))], names=["cell"])

    return run


def frequencies(rows: DataFrame, width: int = WIDTH, sample: int = SAMPLE) -> np.ndarray:
    """How many of some `sample` of rows (row, text), chosen by hash, hold a shingle of each cell: 0 for under three, 255 at most."""
    every = max(1, rows.count() // sample)
    some = rows.where(F.pmod("row", F.lit(every)) == 0).select("text").mapInArrow(_cells(width), "cell int")
    found = some.groupBy("cell").count().where("count > 2").toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[found.column(0).to_numpy()] = np.minimum(found.column(1).to_numpy(), 255)
    return out


def _sketches(width: int, similarity: float, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, words, sizes, first, odd, wide = [], [], [], [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_py(), width)
                name, fp = sketch(h)
                s.append(name), words.append(fp), sizes.append(len(h)), first.append(prefix(h, frequent.value, similarity).view(np.int64)), odd.append(parities(h)), wide.append(wide_parities(h))
            columns = [*np.array(words, np.uint64).reshape(-1, WORDS).T, *np.array(odd, np.uint64).reshape(-1, PARITY).T]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), _signed(s), *map(_signed, columns[:WORDS]), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), *map(_signed, columns[WORDS:]), pa.array(wide, pa.binary())],
                names=["doc_id", "row", "s", *FP, "n", "first", *ODD, "wide"],
            )

    return run


def node_keys(codes: np.ndarray, masks: np.ndarray) -> Iterator[np.ndarray]:
    """Key of each code's node in each table."""
    for i, m in enumerate(masks):
        key = np.full(len(codes), i + 1, np.uint64)
        for w in range(WORDS):
            key = spread(key ^ (codes[:, w] & m[w]), w)
        yield key.view(np.int64)


def _codes(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(f).to_numpy().view(np.uint64) for f in FP], axis=1)


def _members(masks: np.ndarray, held=None):
    """Rows (key, s, words) of each class in each table; with a bitmap only those whose key it holds, without one the keys alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _codes(b)
            for key in node_keys(codes, masks):
                if held is None:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
                elif len(at := np.flatnonzero(held.value.has(key))):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), b.column("s").take(pa.array(at)), *(pa.array(codes[at, w].view(np.int64)) for w in range(WORDS))], names=["key", "s", *FP])

    return run


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a minimum spanning forest of the pairs (a, b), and the tree of each of n points by its least point."""
    tree, edges = np.arange(n), []
    order = np.argsort(distance, kind="stable")
    cut = np.flatnonzero(np.diff(distance[order])) + 1
    for at in np.split(order, cut):
        at = at[tree[a[at]] != tree[b[at]]]
        if not len(at):
            continue
        up = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        for x, y in zip(a[at].tolist(), b[at].tolist()):
            i, j = root(int(tree[x])), root(int(tree[y]))
            if i != j:
                up[max(i, j)] = min(i, j)
                edges.append((x, y))
        for x in up:
            up[x] = root(x)
        tree = np.array([up.get(x, x) for x in tree.tolist()])
        if not tree.any():
            break
    return edges, tree


def forest_of(codes: np.ndarray, distance: int, chunk: int = 256) -> tuple[list[tuple[int, int]], np.ndarray]:
    """spanning_forest() of all pairs of codes within the distance."""
    index = GrayIndex(codes)
    found = []
    for at in range(0, len(codes), chunk):
        here = np.arange(at, min(at + chunk, len(codes)))
        q, c, d = index.near(index.codes[here], distance, here)
        found.append((q + at, c, d.astype(np.int16)))
    a, b, d = map(np.concatenate, zip(*found))
    return spanning_forest(len(codes), index.order[a], index.order[b], d)


_FOREST = f"key long, a long, b long, {_FP}"


def _forest(distance: int):
    """Links (a, b) of each part of a node, whose rows (key, part, s, words, hot) come sorted, and of hot nodes the leaders (a alone, with their words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key, hot = None, False

        def close() -> pa.RecordBatch | None:
            s, codes = (np.concatenate(x) for x in zip(*held))
            if len(s) == 2 and not hot and (s[0] == s[1] or np.bitwise_count(codes[0] ^ codes[1]).sum() > distance):
                return None
            s, at = np.unique(s, return_index=True)
            codes = codes[at]
            edges, tree = forest_of(codes, distance)
            lead = np.unique(tree) if hot else np.zeros(0, np.int64)
            if not edges and not len(lead):
                return None
            a = np.concatenate([s[[x for x, _ in edges]] if edges else s[:0], s[lead]])
            b = np.concatenate([s[[y for _, y in edges]] if edges else s[:0], np.zeros(len(lead), np.int64)])
            words = np.concatenate([np.zeros((len(edges), WORDS), np.uint64), codes[lead]]).view(np.int64)
            leads = np.arange(len(a)) >= len(edges)
            return pa.RecordBatch.from_arrays([pa.array([held_key[0]] * len(a), pa.int64()), pa.array(a), pa.array(b, mask=leads), *(pa.array(words[:, w]) for w in range(WORDS))], names=["key", "a", "b", *FP])

        for batch in batches:
            key, part, s, codes = batch.column("key").to_numpy(), batch.column("part").to_numpy(), batch.column("s").to_numpy(), _codes(batch)
            flag = batch.column("hot").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(key)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                this = (int(key[i]), int(part[i]))
                if this != held_key:
                    if held and (out := close()) is not None:
                        yield out
                    held, held_key, hot = [], this, bool(flag[i])
                held.append((s[i:j], codes[i:j]))
        if held and (out := close()) is not None:
            yield out

    return run


def _forests(members: DataFrame, distance: int, large: int) -> DataFrame:
    rows = members.select("key", "part", "s", *FP, (F.col("count") > large).alias("hot")).repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(_forest(distance), _FOREST)


def candidates(classes: DataFrame, distance: int, masks: np.ndarray, large: int = LARGE) -> DataFrame:
    """(a, b), a < b: links to check among classes (s, words), as forests. Written."""
    rows = classes.where("s <> 0").select("s", *FP)
    nodes = written(rows.mapInArrow(_members(masks), "key long").groupBy("key").count().where("count > 1"), "nodes")
    held = bitmap(nodes, "key")
    member = rows.mapInArrow(_members(masks, held), f"key long, s long, {_FP}").join(nodes, "key")
    parts = F.ceil(F.col("count") / F.lit(large // 2))
    dealt = lambda df: df.withColumn("part", F.when(F.col("count") <= large, F.lit(0)).otherwise(F.pmod(F.xxhash64("s"), parts)).cast("int"))
    found, done, before = [], [nodes], None
    while True:
        out = written(_forests(dealt(member), distance, large), "forests")
        done.append(out)
        found.append(out.where("b IS NOT NULL").select("a", "b"))
        # Leaders of nodes that were dealt out form these nodes anew.
        leaders = out.where("b IS NULL").select("key", F.col("a").alias("s"), *FP)
        nodes = written(leaders.groupBy("key").count(), "nodes")
        done.append(nodes)
        total = nodes.agg(F.sum("count")).first()[0]
        if not total:
            break
        member = leaders.join(nodes, "key")
        if before is not None and total > before / 2:
            i, j, n = F.pmod(F.xxhash64("s"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("j"), parts
            both = member.withColumn("i", i).select("*", j).withColumn("part", F.greatest("i", "j") * n + F.least("i", "j"))
            last = written(_forests(both, distance, large), "forests")
            done.append(last)
            found.append(last.where("b IS NOT NULL").select("a", "b"))
            break
        before = total
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    out = written(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    drop(*done)
    return out


def _shared_rows(held):
    """Rows (key, s) of each class for those of its first shingles that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b.column("first")
            key = first.flatten().to_numpy()
            at = np.flatnonzero(held.value.has(key))
            if len(at):
                of = np.searchsorted(first.value_lengths().to_numpy().cumsum(), at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), b.column("s").take(pa.array(of))], names=["key", "s"])

    return run


def _bucket_pairs(similarity: float, most: int = 1 << 19):
    """Pairs (a, b) of each part of a bucket that have different roots and may be as similar, with how many shingles differ at least and how many may at most; rows come sorted by (key, part), and parts with two sides give the pairs across alone. Without wide parities the short ones decide."""

    def pairs(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((np.diff(c["key"]) != 0) | (np.diff(c["part"]) != 0)) + 1
        edges = np.concatenate([[0], cut, [len(c["key"])]])
        end = np.repeat(edges[1:], np.diff(edges))
        odd = np.stack([c[p] for p in ODD], axis=1).view(np.uint64)
        n, x, step, found, held = c["n"].astype(np.int64), np.arange(len(end)), 0, [], 0
        while True:
            step += 1
            x = x[x + step < end[x]]
            if not len(x):
                break
            y = x + step
            need = least_overlap(n[x] + n[y], similarity)
            ok = (c["root"][x] != c["root"][y]) & (np.minimum(n[x], n[y]) >= need) & (c["across"][x] <= (c["side"][x] != c["side"][y]))
            i, j, may = x[ok], y[ok], np.floor(n[x[ok]] + n[y[ok]] - 2 * need[ok]).astype(np.int64)
            differ = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            found.append(np.stack([i, j, differ, may])[:, differ <= may])
            held += found[-1].shape[1]
            if held > most:
                yield batch(c, found)
                found, held = [], 0
        if held:
            yield batch(c, found)

    def batch(c: dict[str, np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        i, j, differ, may = np.concatenate(found, axis=1)
        if "wide" in c:
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            differ = cells_apart(c["wide"][used].tolist(), *at.reshape(2, -1))
            i, j, differ, may = (v[differ <= may] for v in (i, j, differ, may))
        s = np.sort(np.stack([c["s"][i], c["s"][j]]), axis=0)
        rows = np.unique(np.stack([*s, differ, may], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([*map(pa.array, rows.T.copy())], names=["a", "b", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            here = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            # The last part of a batch may go on in the next one.
            last = np.flatnonzero((here["key"] != here["key"][-1]) | (here["part"] != here["part"][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut or held and (held[-1]["key"][-1], held[-1]["part"][-1]) != (here["key"][0], here["part"][0]):
                held.append({c: v[:cut] for c, v in here.items()})
                yield from pairs({c: np.concatenate([h[c] for h in held]) for c in here})
                held = []
            held.append({c: v[cut:].copy() for c, v in here.items()})
        if held:
            yield from pairs({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return run


def across(classes: DataFrame, root: DataFrame, similarity: float = SIMILARITY, large: int = LARGE) -> DataFrame:
    """(a, b), a < b: pairs to check among classes (s, n, first, short and wide parities), every pair of different groups that is as similar among them; root: group (root) of classes (node) that aren't alone. Written."""
    named = classes.where("s <> 0").join(root.withColumnRenamed("node", "s"), "s", "left")
    named = written(named.select("s", F.coalesce("root", "s").alias("root"), "n", "first", *ODD, "wide"), "named")
    held_by = named.select(F.explode("first").alias("key"), "root").groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    shared = written(held_by.where("least < most").select("key", "least"), "shared")
    held = bitmap(shared, "key")
    led = named.select("s", "first").mapInArrow(_shared_rows(held), "key long, s long").join(shared, "key")
    led = written(led.select(F.col("least").alias("key"), "s").distinct(), "led")
    hot = led.groupBy("key").count().where(F.col("count") > large)
    parts = F.coalesce(F.ceil(F.col("count") / F.lit(max(1, large // 2))), F.lit(1).cast("long"))
    member = led.join(F.broadcast(hot), "key", "left").withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("s"), "parts"))
    member = member.join(named.drop("first"), "s").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    member = member.withColumn("part", F.greatest("side", "other") * F.col("parts") + F.least("side", "other")).withColumn("across", F.expr("part div parts <> part % parts"))
    rows = member.select("key", "part", "side", "across", "s", "root", "n", *ODD, "wide").repartition("key", "part").sortWithinPartitions("key", "part")
    pairs = rows.mapInArrow(_bucket_pairs(similarity), "a long, b long, least long, most long")
    out = written(pairs.select("a", "b").distinct(), "across")
    drop(named, shared, led)
    return out


def _sets(held, width: int):
    """Shingle sets of the rows that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.flatnonzero(held.value.has(b.column(0).to_numpy()))
            sets = [shingle_set(b.column(1)[i].as_py(), width) for i in at.tolist()]
            if sets:
                yield pa.RecordBatch.from_arrays([_signed([sketch_class(h) for h in sets]), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["s", "h"])

    return run


def similar(links: DataFrame, classes: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """Those of links (a, b) whose sets are as similar; rows: row and text of each document. Written."""
    need = links.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(classes.select("s", "row"), "s")
    held = bitmap(need, "row")
    sets = written(rows.select("row", "text").mapInArrow(_sets(held, width), "s long, h array<long>").groupBy("s").agg(F.first("h").alias("h")), "sets")
    own = lambda c: sets.select(F.col("s").alias(c), F.col("h").alias(f"h{c}"))
    both = F.size(F.array_intersect("ha", "hb"))
    checked = links.join(own("a"), "a").join(own("b"), "b").where(both >= F.lit(similarity) * (F.size("ha") + F.size("hb") - both) - F.lit(1e-9))
    out = written(checked.select("a", "b"), "links")
    drop(sets)
    return out


def row_hash(columns: list[str]) -> Column:
    """Hash of all columns, which tells nulls apart."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*cols, *(c.isNull() for c in cols))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, large: int = LARGE) -> DataFrame:
    """doc_id, row (hash of all columns) and root (class that names the group) of each row of docs. Written."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_hash(docs.columns).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequencies(rows, width))
    sketches = written(rows.mapInArrow(_sketches(width, similarity, frequent), f"doc_id long, row long, s long, {_FP}, n int, first array<long>, {_ODD_WORDS}, wide binary"), "sketches")
    classes = written(sketches.groupBy("s").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in (*FP, "n", "first", *ODD, "wide"))), "classes")
    found = candidates(classes, bit_distance(similarity), tables(classes.count(), similarity), large)
    true = similar(found, classes, rows, similarity, width)
    root = connected_components(true)
    missed = across(classes, root, similarity, large)
    more = similar(missed, classes, rows, similarity, width)
    if more.take(1):
        root = connected_components(root.toDF("a", "b").unionByName(more))
    root = root.withColumnRenamed("node", "s")
    out = written(sketches.select("doc_id", "row", "s").join(root, "s", "left").select("doc_id", "row", F.coalesce("root", "s").alias("root")), "groups")
    drop(sketches, classes, found, true, missed, more)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, large: int = LARGE) -> DataFrame:
    """docs with one row of each group of near copies."""
    named = groups(docs, id_col, text_col, similarity, width, large)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    several = written(named.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "several")
    member = written(named.join(several, "root").select("doc_id", "row", (order == F.col("first")).alias("stays")).distinct(), "members")
    held = bitmap(member, "row")
    maybe = F.pandas_udf(lambda row: pd.Series(held.value.has(row.to_numpy())), "boolean")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), row_hash(docs.columns).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    packed = packed.withColumn("maybe", maybe("row"))
    gone = member.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"))
    doubtful = packed.where("maybe").join(gone, (F.col("row") == F.col("gone_row")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    out = packed.where("NOT maybe").select("d").unionByName(doubtful.dropDuplicates(["row", "doc_id"]).select("d"))
    return out.select("d.*")
