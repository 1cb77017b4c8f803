"""Scanned books as a data source of Spark, `scanned_books`: a folder of PDF files that is written in two phases and read by ranges of pages.

Writing. Pages (book, page, width_pt, height_pt, kind, w, h, data, and if there are any spans, layers and what else pdf.Writer.page() takes) are dealt out by book and volume of VOLUME pages, so that a book of any length is several files
on several tasks, and sorted; a task holds one page at a time. Of pages that stand by book and in order already only later volumes are dealt out, so that the pages themselves aren't shuffled. Each attempt writes into a folder of its own, with an index of its files as Parquet, and reports these in its commit message. Only the driver's manifest of an epoch makes them
visible: it is written last and under a temporary name first. A failed attempt removes its folder, an aborted epoch those of all its messages; what a lost executor leaves is never seen. An epoch of a stream that is committed again keeps its
first manifest.

Shelves. With the option shelve, volumes of up to so many bytes don't become files of their own (a file and a font each for a few small pages takes far more disk than the pages): they stand one behind another in a shelf, a file of a task,
compressed in runs of RUN bytes or a bit more, so at most a run and a volume of such a size are in memory; what small files share (syntax) is found again over a run of some hundred books. The font, ten times as long as a small page, stands once at the head of a run and is cut out of its volumes. The index says where a volume's run is, where it stands
in it and where the font goes; with it each is a whole PDF. Larger volumes are files as ever.

Reading. The driver reads the manifests, a row for each task that wrote, with the range of its books and pages; splits are runs of an index's pages, as many as make some SPLIT bytes, PAGES at least, whatever the files' sizes. Filters on book and page are pushed down to manifests,
indexes and pages, and a reading schema of fewer columns leaves images or texts unread: of a file its end, its two lists and the objects of the asked pages are read, each by its byte range. Column read_bytes counts them. Of a shelf the runs with volumes that may hold asked pages are read, each counted at the first page that is found. A split reads those row groups of the index that it needs.

Nulls and edge cases. Pages without a book are a book of their own, in file unnamed_enhanced.pdf. Pages without a number come first in their volume. Pages of one number stay apart, in the order of their data's digest. A page without spans has an empty list. A folder
without manifests has no rows. Texts are UTF-16, so any script comes back.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .pdf import Writer, fonts, objects, plain
from .shared import cleaned, configured

VOLUME, PAGES, SPLIT, BATCH, TAIL, RUN, LEVEL, GROUP, BULK = 1000, 2000, 1 << 28, 4000, 2048, 1 << 21, 3, 1000, 1 << 26
SCHEMA = """book bigint, page int, width_pt double, height_pt double, images array<struct<xref:int,w:int,h:int,bits:int,filter:string,mask:boolean,flipped:boolean,fill:string,size:bigint,data:binary>>,
spans array<struct<x:double,y:double,size:double,text:string>>, read_bytes bigint"""
_IMAGE = pa.struct([("xref", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("bits", pa.int32()), ("filter", pa.string()), ("mask", pa.bool_()), ("flipped", pa.bool_()), ("fill", pa.string()), ("size", pa.int64()), ("data", pa.binary())])
_SPAN = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("size", pa.float64()), ("text", pa.string())])
_TYPES = {"book": pa.int64(), "page": pa.int32(), "width_pt": pa.float64(), "height_pt": pa.float64(), "images": pa.list_(_IMAGE), "spans": pa.list_(_SPAN), "read_bytes": pa.int64()}
_INDEX = pa.schema([("book", pa.int64()), ("first_page", pa.int32()), ("last_page", pa.int32()), ("n_pages", pa.int64()), ("bytes", pa.int64()), ("path", pa.string()), ("begin", pa.int64()), ("stop", pa.int64()), ("run", pa.int64()), ("run_size", pa.int64()), ("run_bytes", pa.int64()), ("place", pa.int64()), ("font", pa.int64()), ("font_bytes", pa.int64())])


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def file_name(book: int | None, first: int | None, last: int | None, whole: bool) -> str:
    own = "unnamed" if book is None else f"book{book}"
    return f"{own}_enhanced.pdf" if whole else f"{own}_p{first}-{last}_enhanced.pdf"


# -- writing ----------------------------------------------------------------------------------------------------------


@dataclass
class Part(D.WriterCommitMessage):
    """What one task has written: its folder and index, and what they hold."""

    folder: str
    index: str
    books: int = 0
    pages: int = 0
    bytes: int = 0
    low: int | None = None
    high: int | None = None
    unnamed: bool = False
    first_page: int | None = None
    last_page: int | None = None


class _Volume:
    """What a Writer writes to: kept in memory up to `most` bytes, beyond that a file."""

    def __init__(self, most: int, start: Callable[[], pa.NativeFile]) -> None:
        self.size, self.most, self.start, self.held, self.out = 0, most, start, [], None

    def write(self, data: bytes | memoryview) -> None:
        self.size += len(data)
        if self.out is None and self.size <= self.most:
            self.held.append(data)
        else:
            if self.out is None:
                self.out = self.start()
                self.out.write(b"".join(self.held))
                self.held = []
            self.out.write(data)


def _values(column: pa.Array) -> list:
    """What to_pylist() gives, without a scalar for each value."""
    kind = column.type
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        rows = [dict(zip(names, v)) for v in zip(*map(_values, column.flatten()))]
        return rows if not column.null_count else [r if there else None for r, there in zip(rows, column.is_valid().to_pylist())]
    if pa.types.is_list(kind):
        flat, at, rows = _values(column.flatten()), 0, []
        for n in _values(column.value_lengths()):
            rows.append(None if n is None else flat[at : at + n])
            at += n or 0
        return rows
    if pa.types.is_binary(kind) or pa.types.is_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


class _Task:
    """Files, shelf and index of a task in a folder of their own."""

    def __init__(self, root: str, part: Part, shelve: int) -> None:
        self.fs, self.base = _system(root)
        self.part, self.shelve, self.home, self.font = part, shelve, posixpath.join(self.base, part.folder), fonts()[0]
        self.rows, self.run, self.filled, self.waiting, self.open, self.shelf, self.index, self.last = [], [self.font], len(self.font), [], [], None, None, ()

    def stream(self, name: str) -> pa.NativeFile:
        self.fs.create_dir(self.home, recursive=True)
        self.open.append(self.fs.open_output_stream(posixpath.join(self.home, name), compression=None))
        return self.open[-1]

    def volume(self) -> _Volume:
        return _Volume(self.shelve, lambda: self.stream("open.part"))

    def close(self, key: tuple, numbers: list, volume: _Volume, font: int) -> None:
        """Ends a volume, whose font stands at `font`."""
        book, number = key
        part, known = self.part, [n for n in numbers if n is not None] if None in numbers else numbers
        first, last, begin = (min(known), max(known), part.pages) if known else (None, None, part.pages)
        part.books += (book,) != self.last
        part.pages += len(numbers)
        part.bytes += volume.size
        self.last = (book,)
        if book is None:
            part.unnamed = True
        else:
            part.low, part.high = (book, book) if part.low is None else (min(part.low, book), max(part.high, book))
        if known:
            part.first_page, part.last_page = (first, last) if part.first_page is None else (min(part.first_page, first), max(part.last_page, last))
        row = (book, first, last, len(numbers), volume.size, None, begin, part.pages)
        if volume.out is None:
            self.waiting.append((row, self.filled, font))
            self.run += [x for x in volume.held if x is not self.font]
            self.filled += volume.size - len(self.font)
            if self.filled >= RUN:
                self.put()
            return
        self.put()  # the index is in the order of pages
        self.open.remove(volume.out)  # the shelf may have been opened after it
        volume.out.close()
        name = file_name(book, number * VOLUME + 1, (number + 1) * VOLUME, number == 0)
        self.fs.move(posixpath.join(self.home, "open.part"), posixpath.join(self.home, name))
        self.note([(*row[:5], f"{part.folder}/{name}", *row[6:], None, None, None, None, None, None)])

    def put(self) -> None:
        """The volumes that wait go to the shelf."""
        if not self.waiting:
            return
        self.shelf = self.shelf or self.stream("shelf")
        at, data, path = self.shelf.tell(), pa.Codec("zstd", compression_level=LEVEL).compress(b"".join(self.run), asbytes=True), f"{self.part.folder}/shelf"
        self.shelf.write(data)
        self.note([(*row[:5], path, *row[6:], at, len(data), self.filled, place, font, len(self.font)) for row, place, font in self.waiting])
        self.run, self.filled, self.waiting = [self.font], len(self.font), []

    def note(self, rows: list[tuple], end: bool = False) -> None:
        self.rows += rows
        if self.rows and (end or len(self.rows) >= GROUP):
            if self.index is None:
                self.fs.create_dir(posixpath.join(self.base, "_index"), recursive=True)
                self.index = pq.ParquetWriter(posixpath.join(self.base, self.part.index), _INDEX, filesystem=self.fs, compression="zstd")
            self.index.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _INDEX)], schema=_INDEX))
            self.rows = []

    def end(self) -> None:
        self.put()
        self.note([], True)
        self.stop()

    def stop(self) -> None:
        for f in [*self.open, *filter(None, [self.index])]:
            f.close()


def _volumes(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple]]:
    """Where the volumes of a batch of sorted pages begin, and their keys: book and number of the volume."""
    book, page = batch.column("book"), pc.fill_null(batch.column("page"), 1).to_numpy(zero_copy_only=False)
    parts = [pc.fill_null(book, 0).to_numpy(zero_copy_only=False), book.is_valid().to_numpy(zero_copy_only=False), np.maximum(page - 1, 0) // VOLUME]
    starts = np.concatenate([[0], 1 + np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in parts]))])
    return starts, [(b if there else None, v) for b, there, v in zip(*(x[starts].tolist() for x in parts))]


def write_part(batches: Iterator[pa.RecordBatch], root: str, folder: str, shelve: int = 0) -> Part:
    """Files of sorted pages in a folder of their own below root, with their index."""
    part = Part(f"data/{folder}", f"_index/{folder}.parquet")
    task, key, numbers, writer = _Task(root, part, shelve), None, [], None

    def close() -> None:
        writer.close()
        task.close(key, numbers, volume, writer.fonts)

    try:
        for b in batches:
            if not b.num_rows:
                continue
            starts, keys = _volumes(b)
            every, ends = _values(b.column("page")), [*starts[1:].tolist(), b.num_rows]
            made = None
            if plain(b, BULK):
                numbered = np.full(len(starts), 6)
                numbered[0] += len(writer.at) if key == keys[0] else 0
                made, places = objects(b, np.repeat(numbered - 3 * starts, np.diff([*starts, b.num_rows])) + 3 * np.arange(b.num_rows))
            else:
                rows = zip(*map(_values, b.columns))
            for at, first, end in zip(keys, starts.tolist(), ends):
                if at != key:
                    if key is not None:
                        close()
                    key, numbers, volume = at, [], task.volume()
                    writer = Writer(volume)
                if made is not None:
                    writer.pages(made[places[3 * first] : places[3 * end]], places[3 * first : 3 * end + 1], every[first:end])
                else:
                    for _ in range(first, end):
                        writer.page(dict(zip(b.schema.names, next(rows))))
                numbers += every[first:end]
        if key is not None:
            close()
        task.end()
    except BaseException:
        task.stop()
        remove(root, part)
        raise
    return part


def remove(root: str, part: Part) -> None:
    """Takes away the files of a part."""
    fs, base = _system(root)
    for path, kind in ((part.folder, pafs.FileType.Directory), (part.index, pafs.FileType.File)):
        full = posixpath.join(base, path)
        if fs.get_file_info(full).type == kind:
            fs.delete_dir(full) if kind == pafs.FileType.Directory else fs.delete_file(full)


def delete(root: str) -> None:
    """Takes away a folder of books."""
    fs, base = _system(root)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)


def manifests(root: str) -> list[str]:
    fs, base = _system(root)
    found = fs.get_file_info(pafs.FileSelector(posixpath.join(base, "_manifest"), allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


def commit(root: str, epoch: str, parts: list[Part | None], overwrite: bool = False) -> bool:
    """Makes the parts visible as one; False, with their files removed, if the epoch is there already."""
    fs, base = _system(root)
    final = posixpath.join(base, "_manifest", f"{epoch}.json")
    before = manifests(root)
    if final in before:
        for p in filter(None, parts):
            remove(root, p)
        return False
    fs.create_dir(posixpath.join(base, "_manifest"), recursive=True)
    with fs.open_output_stream(f"{final}.part", compression=None) as f:
        f.write(json.dumps([vars(p) for p in parts if p and p.pages], sort_keys=True).encode())
    fs.move(f"{final}.part", final)
    for old in before if overwrite else []:
        gone = parts_of(fs, old)
        fs.delete_file(old)
        for p in gone:
            remove(root, p)
    return True


def parts_of(fs: pafs.FileSystem, manifest: str) -> list[Part]:
    with fs.open_input_stream(manifest, compression=None) as f:
        return [Part(**p) for p in json.loads(f.read())]


class _BatchWriter(D.DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool, shelve: int = 0) -> None:
        self.root, self.overwrite, self.epoch, self.shelve = root, overwrite, uuid.uuid4().hex, shelve

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return write_part(iterator, self.root, _attempt(self.epoch), self.shelve)

    def commit(self, messages: list[Part | None]) -> None:
        commit(self.root, self.epoch, messages, self.overwrite)

    def abort(self, messages: list[Part | None]) -> None:
        for p in filter(None, messages):
            remove(self.root, p)


class _StreamWriter(D.DataSourceStreamArrowWriter):
    def __init__(self, root: str, shelve: int = 0) -> None:
        self.root, self.shelve = root, shelve

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return write_part(iterator, self.root, _attempt("stream"), self.shelve)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        commit(self.root, f"epoch{batchId:012d}", messages)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        for p in filter(None, messages):
            remove(self.root, p)


def _attempt(epoch: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{epoch}-{task.partitionId() if task else 0}-{uuid.uuid4().hex}"


# -- reading ----------------------------------------------------------------------------------------------------------


_NUMBERS, _KIDS = re.compile(rb"/QuirePages \[(.*?)\]", re.S), re.compile(rb"/Kids \[(.*?)\]", re.S)
_PAGE = re.compile(rb"/MediaBox \[0 0 ([\d.]+) ([\d.]+)\] /Resources << /XObject << (.*?) >> /Font .*?/Contents (\d+) 0 R", re.S)
_HEAD = re.compile(rb"/Width (\d+) /Height (\d+) (?:/ColorSpace /\w+|(/ImageMask true) /Decode \[(\d)[^\]]*\]) /BitsPerComponent (\d+) (?:/Interpolate true )?/Filter /(\w+) /Length (\d+) >>\nstream\n")
_TEXT = re.compile(rb"/F1 ([\d.]+) Tf ([-\d.]+) ([-\d.]+) Td <([0-9a-f]*)> Tj")
_FILL = re.compile(rb"q (?:([\d. ]+ rg) )?[-\d. ]+ cm /Im(\d+) Do")


class Pdf:
    """Random access to a file of Writer, or to the bytes of one: reads its end, its lists and the objects asked for, and counts the bytes."""

    def __init__(self, source) -> None:
        self.source, self.read, self.held = source, 0, isinstance(source, bytes)
        size = len(source) if self.held else source.size()
        at = max(0, size - TAIL)
        tail = self._bytes(at, size)
        start = int(tail[tail.rfind(b"startxref") :].split()[1])
        table = tail[start - at :] if start >= at else self._bytes(start, at) + tail
        # xref, 0 and how many, then three words for each object, the first of which is none.
        self.at = [0, *map(int, table[: table.rfind(b"trailer")].split()[6::3])]
        order = sorted(self.at[1:])
        order.append(start)
        self.stop = dict(zip(order, order[1:]))
        self.kids = [int(x) for x in _KIDS.search(self.object(2))[1].split()[::3]]
        self.numbers = [None if x == b"null" else int(x) for x in _NUMBERS.search(self.object(1))[1].split()]

    def _bytes(self, a: int, b: int) -> bytes:
        self.read += b - a
        return self.source[a:b] if self.held else self.source.read_at(b - a, a)

    def object(self, number: int, most: int | None = None) -> bytes:
        a = self.at[number]
        return self._bytes(a, self.stop[a] if most is None else min(self.stop[a], a + most))

    def page(self, i: int) -> tuple[bytes, bytes, list[int], int]:
        """Width and height, and the numbers of a page's images and of its content."""
        width, height, named, content = _PAGE.search(self.object(self.kids[i])).groups()
        return width, height, [int(x) for x in named.split()[1::4]], int(content)

    def image(self, ref: int, fill: str | None, data: bool) -> tuple:
        """An image in the order of _IMAGE."""
        body = self.object(ref, None if data else 320)
        m = _HEAD.search(body)
        w, h, mask, decode, bits, filt, size = m.groups()
        size = int(size)
        return ref, int(w), int(h), int(bits), filt.decode(), mask is not None, decode == b"1", fill, size, body[m.end() : m.end() + size] if data else None


def texts(content: bytes) -> list[tuple]:
    """Hidden text of a page in the order of _SPAN."""
    return [(float(x), float(y), float(s), bytes.fromhex(t.decode()).decode("utf-16-be")) for s, x, y, t in _TEXT.findall(content)]


def fills(content: bytes) -> dict[int, str | None]:
    """Colours of a page's images by their places."""
    return {int(n): fill.decode() or None for fill, n in _FILL.findall(content)}


class _Columns:
    """Values of a batch column by column; those of a list's structs field by field, and where each list ends."""

    def __init__(self, types: dict[str, pa.DataType]) -> None:
        self.types, self.flat, self.nested = types, {}, {}
        for c, t in types.items():
            if pa.types.is_list(t):
                whole = {"images": _IMAGE, "spans": _SPAN}[c]
                self.nested[c] = [0], [(whole.get_field_index(f.name), []) for f in t.value_type]
            else:
                self.flat[c] = []

    def add(self, column: str, items: list[tuple]) -> None:
        ends, fields = self.nested[column]
        ends.append(ends[-1] + len(items))
        for i, values in fields:
            for x in items:
                values.append(x[i])

    def batch(self) -> pa.RecordBatch:
        lists = {c: _lists(self.types[c], ends, [pa.array(v, f.type) for f, (_, v) in zip(self.types[c].value_type, fields)]) for c, (ends, fields) in self.nested.items()}
        return pa.RecordBatch.from_arrays([lists[c] if c in lists else pa.array(self.flat[c], t) for c, t in self.types.items()], names=list(self.types))


def _lists(kind: pa.DataType, ends: list[int] | np.ndarray, fields: list[pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind)


#: Objects of a page of one image, as Writer makes them; all that stands before an image's data.
_SIZES = r"^\d+ 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox \[0 0 (?P<width_pt>[\d.]+) (?P<height_pt>[\d.]+)\]"
_OBJECTS = r"^\d+ 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox \[0 0 (?P<width_pt>[\d.]+) (?P<height_pt>[\d.]+)\] /Resources << /XObject << /Im0 (?P<image>\d+) 0 R >> /Font << /F1 3 0 R >> >> /Contents (?P<content>\d+) 0 R"
_IMAGES = r"^(?P<head>\d+ 0 obj\n<< /Type /XObject /Subtype /Image /Width (?P<w>\d+) /Height (?P<h>\d+) (?:/ColorSpace /\w+|(?P<mask>/ImageMask true) /Decode \[(?P<flipped>\d)[^\]]*\]) /BitsPerComponent (?P<bits>\d+) (?:/Interpolate true )?/Filter /(?P<filter>\w+) /Length (?P<size>\d+) >>\nstream\n)"


@lru_cache(maxsize=256)
def _kids(body: bytes) -> list[int]:
    return [int(x) for x in _KIDS.search(body)[1].split()[::3]]


@lru_cache(maxsize=256)
def _numbers(body: bytes) -> list[int | None]:
    return [None if x == b"null" else int(x) for x in _NUMBERS.search(body)[1].split()]


class _Run:
    """Volumes of a run of a shelf, read together. Objects are found by each volume's list of places; end is that of the next object, or of none if they don't stand in a writer's order (right is False then)."""

    def __init__(self, data: bytes, places: list[int], fonts: list[int]) -> None:
        self.data, self.places = data, np.array(places)
        raw, tables = np.frombuffer(data, np.uint8), self.places + np.array(fonts)  # the list of places follows the font
        ends = [data.index(b"\n", t + 7) for t in tables.tolist()]
        counts = np.array([int(data[t + 7 : e]) - 1 for t, e in zip(tables.tolist(), ends)])  # object 0 is none
        self.first = np.cumsum(counts) - counts
        number = np.arange(counts.sum()) - np.repeat(self.first, counts) + 1
        digits = raw[(np.repeat(ends, counts) + 1 + 20 * number)[:, None] + np.arange(10)].astype(np.int64) - 48
        self.at = digits @ 10 ** np.arange(9, -1, -1) + np.repeat(self.places, counts)
        # 6 and so on, then 1, 2 and what all share.
        self.end = np.append(self.at[1:], 0)
        self.end[self.first + counts - 1] = self.at[self.first]
        known = (number <= 2) | (number > 5)
        self.right = bool(np.all(counts >= 5) and np.all(self.at[known] < self.end[known]))

    def objects(self, volumes: np.ndarray, numbers: np.ndarray, most: int | None = None) -> list[bytes]:
        i = self.first[volumes] + numbers - 1
        at, end, data = self.at[i], self.end[i], self.data
        return [data[a:b] for a, b in zip(at.tolist(), (end if most is None else np.minimum(end, at + most)).tolist())]


def _found(bodies: list[bytes], pattern: str) -> dict[str, pa.Array] | None:
    """Groups of a pattern by name, as texts; None if it isn't found everywhere."""
    got = pc.extract_regex(pa.array(bodies, pa.binary()), pattern)
    return None if got.null_count else {f.name: x.cast(pa.string()) for f, x in zip(got.type, got.flatten())}


@dataclass
class Split(D.InputPartition):
    """Pages [start, stop) of an index, in the order of its files."""

    index: str
    start: int
    stop: int

    def __init__(self, index: str, start: int, stop: int) -> None:
        self.value = self.index, self.start, self.stop = index, start, stop


#: Comparisons that are pushed down.
_TESTS = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.In: "in"}


class _Reader(D.DataSourceReader):
    def __init__(self, root: str, schema: StructType, options: dict) -> None:
        self.root, self.columns = root, schema.fieldNames()
        self.types = {f.name: _TYPES[f.name] for f in schema.fields}
        self.images = []
        for f in schema.fields:
            if f.name in ("images", "spans"):
                names, whole = f.dataType.elementType.fieldNames(), _TYPES[f.name].value_type
                self.types[f.name] = pa.list_(pa.struct([whole.field(n) for n in names]))
                self.images = names if f.name == "images" else self.images
        self.size = int(options.get("pages_per_split", 0))
        #: Bounds that hold for book and page: (least, most, values or None).
        self.bounds = {"book": [None, None, None], "page": [None, None, None]}
        if "pages" in options:
            first, last = page_range(options["pages"])
            self._bound("page", ">=", first)
            self._bound("page", "<=", last)

    def _bound(self, column: str, test: str, value) -> None:
        b = self.bounds[column]
        if test in (">", ">=", "="):
            low = value + (test == ">")
            b[0] = low if b[0] is None else max(b[0], low)
        if test in ("<", "<=", "="):
            high = value - (test == "<")
            b[1] = high if b[1] is None else min(b[1], high)
        if test == "in":
            b[2] = set(value) if b[2] is None else b[2] & set(value)

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            test, name = _TESTS.get(type(f)), getattr(f, "attribute", (None,))
            if isinstance(f, D.IsNotNull) and len(name) == 1 and name[0] in self.bounds:
                yield f  # kept by Spark, too: says nothing about which pages to read
            elif test and len(name) == 1 and name[0] in self.bounds and f.value is not None:
                self._bound(name[0], test, f.value)
            else:
                yield f

    def _open(self, low, high, unnamed: bool, column: str) -> bool:
        """Whether values within low..high, or nulls, can meet the bounds of a column."""
        least, most, values = self.bounds[column]
        if least is None and most is None and values is None:
            return True
        return low is not None and (least is None or high >= least) and (most is None or low <= most) and (values is None or any(low <= v <= high for v in values))

    def _test(self, column: str) -> Callable[[int | None], bool] | None:
        """Whether a value meets the bounds of a column; None where there are none."""
        return None if self.bounds[column] == [None, None, None] else lambda value: self._open(value, value, value is None, column)

    def partitions(self) -> list[Split]:
        fs, _ = _system(self.root)
        parts = [p for m in manifests(self.root) for p in parts_of(fs, m)]
        parts = [p for p in parts if self._open(p.low, p.high, p.unnamed, "book") and self._open(p.first_page, p.last_page, True, "page")]
        size = lambda p: self.size or max(PAGES, SPLIT * p.pages // max(p.bytes, 1))
        return [Split(p.index, a, min(a + size(p), p.pages)) for p in parts for a in range(0, p.pages, size(p))] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.start == split.stop:
            return
        fs, base = _system(self.root)
        wanted = (pc.field("begin") < split.stop) & (pc.field("stop") > split.start)
        index = pq.read_table(posixpath.join(base, split.index), filesystem=fs, filters=wanted)
        columns = ("book", "first_page", "last_page", "n_pages", "bytes", "path", "begin", "run", "run_size", "run_bytes", "place", "font", "font_bytes")
        volumes = zip(*(_values(index.column(c).combine_chunks()) for c in columns))
        of_book = self._test("book")
        volumes = [v for v in volumes if (not of_book or of_book(v[0])) and self._open(v[1], v[2], True, "page")]
        more = 0
        for (path, run), group in groupby(volumes, key=lambda v: (v[5], v[7])):
            group = list(group)
            with fs.open_input_file(posixpath.join(base, path)) as f:
                if run is None:
                    yield from self._one_by_one([Pdf(f)], group, split, None)
                    continue
                size, size_before = group[0][8:10]
                data = pa.decompress(f.read_at(size, run), size_before, "zstd", asbytes=True)
            more += size
            batches = self._together(data, group, split, more)
            if batches is None:
                pdfs = (Pdf(b"".join((data[place : place + font], data[:shared], data[place + font : place + size - shared]))) for _, _, _, _, size, *_, place, font, shared in group)
                batches = self._one_by_one(pdfs, group, split, more)
            for b in batches:
                yield b
                more = 0

    def _one_by_one(self, pdfs: Iterable[Pdf], volumes: list[tuple], split: Split, more: int | None) -> Iterator[pa.RecordBatch]:
        """Pages of volumes; more: bytes that were read of a shelf, counted at the first page."""
        out, n, held, of_page = _Columns(self.types), 0, 0, self._test("page")
        for pdf, (book, _, _, n_pages, _, _, begin, *_) in zip(pdfs, volumes):
            counted = 0
            for i in range(max(split.start - begin, 0), min(split.stop - begin, n_pages)):
                number = pdf.numbers[i]
                if of_page and not of_page(number):
                    continue
                self._take(pdf, i, out)
                if "book" in out.flat:
                    out.flat["book"].append(book)
                if "page" in out.flat:
                    out.flat["page"].append(number)
                own, counted = pdf.read - counted, pdf.read
                if "read_bytes" in out.flat:
                    out.flat["read_bytes"].append(own if more is None else more)
                n, held, more = n + 1, held + own, None if more is None else 0
                if n >= BATCH or held > 1 << 24:
                    yield out.batch()
                    out, n, held = _Columns(self.types), 0, 0
        if n:
            yield out.batch()

    def _together(self, data: bytes, volumes: list[tuple], split: Split, more: int) -> list[pa.RecordBatch] | None:
        """Pages of a run's volumes, if they are an image each; None if some aren't."""
        run = _Run(data, [v[10] for v in volumes], [v[11] for v in volumes])
        if not run.right:
            return None
        every = np.arange(len(volumes))
        kids, numbers, counts = [], [], []
        for first, second, (_, _, _, n_pages, _, _, begin, *_) in zip(run.objects(every, np.ones_like(every)), run.objects(every, np.full_like(every, 2)), volumes):
            a, b = max(split.start - begin, 0), min(split.stop - begin, n_pages)
            kids += _kids(second[6:])[a:b]
            numbers += _numbers(first)[a:b]
            counts.append(b - a)
        at, kids, page = np.repeat(every, counts), np.array(kids), pa.array(numbers, pa.int32())
        least, most, values = self.bounds["page"]
        if self._test("page"):
            number = pc.fill_null(page, 0).to_numpy()
            kept = page.is_valid().to_numpy(zero_copy_only=False) & (number >= (number if least is None else least)) & (number <= (number if most is None else most))
            if values is not None:
                kept &= np.isin(number, list(values))
            at, kids, page = at[kept], kids[kept], page.filter(pa.array(kept))
        if not len(at):
            return []
        counted = np.zeros(len(at), np.int64)
        counted[0] = more
        made = {"book": pa.array([v[0] for v in volumes], pa.int64()).take(pa.array(at)), "page": page, "read_bytes": pa.array(counted)}
        wanted = set(self.types) - set(made)
        if wanted:
            listed = wanted & {"images", "spans"}
            found = _found(run.objects(at, kids), _OBJECTS if listed else _SIZES)
            if found is None:
                return None
            made |= {c: found[c].cast(pa.float64()) for c in ("width_pt", "height_pt")}
            ref = lambda c: found[c].cast(pa.int32()).to_numpy()
            contents = run.objects(at, ref("content")) if "spans" in wanted or "fill" in self.images else []
            if "spans" in wanted:
                lines = [_TEXT.findall(c) for c in contents]
                flat = [x for own in lines for x in own]
                number = lambda i: pa.array([x[i] for x in flat], pa.binary()).cast(pa.string()).cast(pa.float64())
                of = {"size": lambda: number(0), "x": lambda: number(1), "y": lambda: number(2), "text": lambda: pa.array([bytes.fromhex(x[3].decode()).decode("utf-16-be") for x in flat], pa.string())}
                made["spans"] = _lists(self.types["spans"], np.concatenate([[0], np.cumsum([len(x) for x in lines])]), [of[f.name]() for f in self.types["spans"].value_type])
            if "images" in wanted:
                image = self._images(run, at, ref("image"), contents)
                if image is None:
                    return None
                made["images"] = _lists(self.types["images"], np.arange(len(at) + 1), image)
        return [pa.RecordBatch.from_arrays([made[c] for c in self.types], names=list(self.types))]

    def _images(self, run: _Run, volumes: np.ndarray, refs: np.ndarray, contents: list[bytes]) -> list[pa.Array] | None:
        """Fields of a page's one image."""
        bodies = run.objects(volumes, refs, None if "data" in self.images else 320)
        found = _found([b[:320] for b in bodies] if "data" in self.images else bodies, _IMAGES)
        if found is None:
            return None
        made = {"xref": lambda: pa.array(refs, pa.int32()), "mask": lambda: pc.not_equal(found["mask"], ""), "flipped": lambda: pc.equal(found["flipped"], "1"), "fill": lambda: pa.array([fills(c).get(0) for c in contents], pa.string())}
        made["data"] = lambda: pa.array([b[a : a + n] for b, a, n in zip(bodies, pc.binary_length(found["head"]).to_pylist(), found["size"].cast(pa.int64()).to_pylist())], pa.binary())
        return [made[f.name]() if f.name in made else found[f.name].cast(f.type) for f in self.types["images"].value_type]

    def _take(self, pdf: Pdf, i: int, out: _Columns) -> None:
        """What is asked for of a page, from its own objects."""
        sized, images, spans = "width_pt" in out.flat or "height_pt" in out.flat, "images" in out.nested, "spans" in out.nested
        if not (sized or images or spans):
            return
        width, height, refs, at = pdf.page(i)
        if "width_pt" in out.flat:
            out.flat["width_pt"].append(float(width))
        if "height_pt" in out.flat:
            out.flat["height_pt"].append(float(height))
        content = pdf.object(at) if spans or "fill" in self.images else b""
        if spans:
            out.add("spans", texts(content))
        if images:
            fill = fills(content) if "fill" in self.images else {}
            out.add("images", [pdf.image(ref, fill.get(k), "data" in self.images) for k, ref in enumerate(refs)])


def page_range(text: str) -> tuple[int, int]:
    """First and last page (from 1) of `N`, the first N, or `a-b`."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", text)
    if not m:
        raise ValueError(f"neither a number of pages nor a range: {text!r}")
    return (1, int(m[1])) if m[2] is None else (int(m[1]), int(m[2]))


class ScannedBooks(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "scanned_books"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _BatchWriter:
        return _BatchWriter(self.options["path"], overwrite, int(self.options.get("shelve", 0)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"], int(self.options.get("shelve", 0)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters to it."""
    spark.dataSource.register(ScannedBooks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def dealt(pages: DataFrame, by_book: bool = False) -> DataFrame:
    """Pages as a writer takes them: by book and volume, in order. by_book: those of a book are in one partition and in order already, as a window leaves them; first volumes stay there."""
    volume = F.floor(F.greatest(F.coalesce("page", F.lit(1)) - 1, F.lit(0)) / VOLUME)
    if by_book:
        return pages.where(volume == 0).union(dealt(pages.where(volume > 0)))
    return pages.repartition("book", volume).sortWithinPartitions("book", volume, "page", F.xxhash64("data"))


def write(pages: DataFrame, path: str, overwrite: bool = False, by_book: bool = False, **options) -> None:
    register(pages.sparkSession)
    # Pages grow in a writer: tasks of a quarter of Spark's usual size, or the last few take long.
    with cleaned(pages.sparkSession), configured(pages.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"):
        dealt(pages, by_book).write.format("scanned_books").options(**options).mode("overwrite" if overwrite else "append").save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """The pages of a folder of books, with the given columns alone.

    Spark 4.1 keeps the filters that a query has pushed to a Python source for later queries of the same DataFrame, unless these push filters of their own. The condition on read_bytes, which always holds, makes each query do so; whoever reads the
    format without this function must take a new DataFrame for each query."""
    register(spark)
    names = StructType.fromDDL(columns).fieldNames()
    full = columns if "read_bytes" in names else f"{columns}, read_bytes bigint"
    return spark.read.format("scanned_books").schema(full).options(**options).load(path).where("read_bytes >= 0").select(*names)
