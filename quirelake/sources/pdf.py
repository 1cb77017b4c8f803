"""Pages of scans as PDF: the objects of a file, written one by one, and headers of JPEG data. Folders of books are sources.books.

A page comes encoded: jpeg, gray or bits (deflated 1-bit rows, ink 0), or as a payload of operators.encode: an image, or a background with painted stencils.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stream filter, colour space and bits of each kind of payload (fixed values).
KINDS = {"jpeg": ("DCTDecode", "DeviceRGB", 8), "gray": ("FlateDecode", "DeviceGray", 8), "bits": ("FlateDecode", "DeviceGray", 1)}
SPACES = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}
#: Short names of stream filters in listings (fixed values).
FILTERS = {"DCTDecode": "JPEG", "JBIG2Decode": "JBIG2", "FlateDecode": "Flate", "CCITTFaxDecode": "G4", "JPXDecode": "JPEG2000"}


@lru_cache(maxsize=1 << 14)
def _place(x0: float, y0: float, y1: float, height: float) -> str:
    return f"BT 3 Tr /F1 {max(2.0, min(y1 - y0, 60.0)):.2f} Tf {x0:.2f} {height - y1:.2f} Td <"


def hidden_text(spans: list, height: float) -> bytes:
    """Invisible text of any script, as UTF-16, on the lower edge of its box, in a size within 2..60."""
    return "\n".join([f"{_place(x['x0'], x['y0'], x['y1'], height)}{x['text'].encode('utf-16-be', 'surrogatepass').hex()}> Tj ET" for x in spans]).encode()


@lru_cache(maxsize=1 << 14)
def _sized(width: float, height: float) -> tuple[str, str]:
    """Matrix of an image that fills a page of this size, and the head of the page."""
    return f"{width:.4f} 0 0 {height:.4f} 0 0 cm", f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:.2f} {height:.2f}] /Resources << /XObject <<"


@lru_cache(maxsize=1 << 14)
def _image_head(w: int, h: int, filt: str, space: str | None, bits: int, interpolate: bool) -> bytes:
    kind = f"/ColorSpace /{space} " if space else "/ImageMask true /Decode [0 1] "
    smooth = "/Interpolate true " if interpolate else ""
    return f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} {kind}/BitsPerComponent {bits} {smooth}/Filter /{filt} ".encode()


def fill_operator(b: int, g: int, r: int) -> str:
    return f"{r / 255:.4f} {g / 255:.4f} {b / 255:.4f} rg"


@lru_cache(maxsize=1)
def fonts() -> tuple[bytes, tuple[int, ...]]:
    """Objects 3 to 5, which all files share: the font of the hidden text, its glyphs and its characters, a stream that maps each 16-bit code to itself, row by row of 256. With where each begins."""
    rows = [b"<%02x00> <%02xff> <%02x00>" % (i, i, i) for i in range(256)]
    blocks = b"\n".join(b"%d beginbfrange\n%s\nendbfrange" % (len(part), b"\n".join(part)) for part in (rows[i : i + 100] for i in range(0, 256, 100)))
    body = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Hidden def /CMapType 2 def\n1 begincodespacerange <0000> <ffff> endcodespacerange\n" + blocks + b"\nendcmap end end"
    # Codes of the hidden text are UTF-16 itself; the font is never painted, so it has no outlines.
    bodies = [
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Hidden /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Hidden /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /CIDToGIDMap /Identity >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body),
    ]
    objects = [b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(bodies, 3)]
    return b"".join(objects), (0, len(objects[0]), len(objects[0] + objects[1]))


@lru_cache(maxsize=1 << 10)
def _lists(numbers: tuple[int | None, ...], kids: tuple[int, ...]) -> tuple[bytes, bytes]:
    """Catalogue and page list."""
    named, refs = " ".join(["null" if n is None else str(n) for n in numbers]), " ".join([f"{k} 0 R" for k in kids])
    return f"1 0 obj\n<< /Type /Catalog /Pages 2 0 R /QuirePages [{named}] >>\nendobj\n".encode(), f"2 0 obj\n<< /Type /Pages /Kids [{refs}] /Count {len(kids)} >>\nendobj\n".encode()


class Writer:
    """Writes a PDF to a stream, object by object; only the places of objects stay in memory."""

    def __init__(self, out) -> None:
        self.out, self.at, self.size, self.kids, self.numbers = out, [], 0, [], []  # at: of the objects from 6 on; before: 1 the catalogue, 2 the page list, 3 to 5 the font
        self.fonts = 0  # where these begin
        self._put(b"%PDF-1.4\n")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _stream(self, head: bytes, data: bytes) -> int:
        self.at.append(self.size)
        number = len(self.at) + 5
        self._put(b"%d 0 obj\n%b/Length %d >>\nstream\n%b\nendstream\nendobj\n" % (number, head, len(data), data))
        return number

    def image(self, w: int, h: int, filt: str, data: bytes, space: str | None, bits: int = 8, interpolate: bool = False) -> int:
        """An image, or with no colour space a stencil that paints its zero samples."""
        return self._stream(_image_head(w, h, filt, space, bits, interpolate), data)

    def page(self, p: dict, interpolate: bool = False) -> None:
        """A page (width_pt, height_pt, kind, w, h, data, spans); of kind layers or image also filter, channels, layers, mask_w, mask_h."""
        height, kind, spans = p["height_pt"], p["kind"], p.get("spans")
        filt, space, bits = KINDS[kind] if kind in KINDS else (p["filter"], SPACES[p["channels"]], 8)
        matrix, head = _sized(p["width_pt"], height)
        number = self.image(p["w"], p["h"], filt, p["data"], space, bits, interpolate)
        paint, named = f"q {matrix} /Im0 Do Q\n", f"/Im0 {number} 0 R"
        for i, x in enumerate(p["layers"] if kind == "layers" else (), 1):
            number = self.image(p["mask_w"], p["mask_h"], x["filter"], x["data"], None, 1)
            paint, named = f"{paint}q {fill_operator(x['b'], x['g'], x['r'])} {matrix} /Im{i} Do Q\n", f"{named} /Im{i} {number} 0 R"
        content = self._stream(b"<< ", paint.encode() + hidden_text(spans, height) if spans else paint.encode())
        self.numbers.append(p.get("page"))
        self.kids.append(content + 1)
        self.at.append(self.size)
        self._put(f"{content + 1} 0 obj\n{head} {named} >> /Font << /F1 3 0 R >> >> /Contents {content} 0 R >>\nendobj\n".encode())

    def pages(self, objects: memoryview, places: list[int], numbers: list[int | None]) -> None:
        """Pages whose objects are made already, three each (plain), and where these stand, the end included."""
        shift, first = self.size - places[0], len(self.at) + 6
        self.at += [x + shift for x in places[:-1]]
        self.numbers += numbers
        self.kids += range(first + 2, first + 3 * len(numbers), 3)
        self._put(objects)

    def close(self) -> int:
        """Ends the file; returns its size."""
        catalogue, pages = _lists(tuple(self.numbers), tuple(self.kids)) if len(self.kids) < 100 else _lists.__wrapped__(self.numbers, self.kids)
        shared, begins = fonts()
        at = self.size
        self.fonts = at + len(catalogue) + len(pages)
        places = [at, at + len(catalogue), *[self.fonts + x for x in begins], *self.at]
        start, n = self.fonts + len(shared), len(places)
        table = (b"%010d 00000 n \n" * n) % tuple(places)
        self._put(catalogue + pages)
        self._put(shared)  # as it is: shelves leave it out
        self._put(b"xref\n0 %d\n0000000000 65535 f \n%btrailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n + 1, table, n + 1, start))
        return self.size


def _each(values: pa.Array | np.ndarray, text) -> pa.Array:
    """text(value) of each value, worked out once for each distinct one."""
    coded = (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode()
    return pa.array([text(v).encode() for v in coded.dictionary.to_pylist()], pa.binary()).take(coded.indices)


def _joined(*parts) -> pa.Array:
    """Bytes put together row by row from arrays of bytes or of whole numbers and from fixed bytes."""
    plain = lambda x: pa.scalar(x, pa.binary()) if isinstance(x, bytes) else x if pa.types.is_binary(x.type) else x.cast(pa.string()).view(pa.binary())
    return pc.binary_join_element_wise(*map(plain, parts), b"")


def _utf16(texts: pa.Array) -> pa.Array:
    """Hexadecimal digits of the texts' UTF-16."""
    every, ends = "".join(texts.to_pylist()).encode("utf-16-be", "surrogatepass"), np.concatenate([[0], np.cumsum(4 * pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    if 2 * len(every) != ends[-1]:  # characters of four bytes
        return pa.array([t.encode("utf-16-be", "surrogatepass").hex().encode() for t in texts.to_pylist()], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(every.hex().encode())])


def plain(batch: pa.RecordBatch, most: int) -> bool:
    """Whether the pages of a batch, of up to so many bytes, are an image and texts each, with nothing missing, so that objects() makes them."""
    held = dict(zip(batch.schema.names, batch.columns))
    need = [held.get(c) for c in ("width_pt", "height_pt", "kind", "w", "h", "data")]
    types = (pa.types.is_float64, pa.types.is_float64, pa.types.is_string, pa.types.is_integer, pa.types.is_integer, pa.types.is_binary)
    if batch.nbytes > most or not all(c is not None and not c.null_count and test(c.type) for c, test in zip(need, types)) or not pc.all(pc.is_in(need[2], pa.array(list(KINDS)))).as_py():
        return False
    spans = held.get("spans")
    if spans is None:
        return True
    if not pa.types.is_list(spans.type) or not pa.types.is_struct(spans.type.value_type):
        return False
    flat = spans.flatten()
    parts = dict(zip([f.name for f in flat.type], flat.flatten()))
    return not flat.null_count and all(c in parts and not parts[c].null_count and test(parts[c].type) for c, test in (("x0", pa.types.is_float64), ("y0", pa.types.is_float64), ("y1", pa.types.is_float64), ("text", pa.types.is_string)))


def objects(batch: pa.RecordBatch, first: np.ndarray) -> tuple[memoryview, list[int]]:
    """The objects of plain pages, as Writer.page() makes them, of the numbers `first` and the two that follow; and where each begins, the end included."""
    column = batch.column
    width, height, data, n = column("width_pt"), column("height_pt"), column("data"), pa.array(first)
    hidden = b""
    if "spans" in batch.schema.names:
        spans = column("spans")
        counts, flat = pc.fill_null(spans.value_lengths(), 0).to_numpy(zero_copy_only=False), spans.flatten()
        part = dict(zip([f.name for f in flat.type], flat.flatten()))
        x0, y0, y1 = (part[c].to_numpy() for c in ("x0", "y0", "y1"))
        two = lambda v: f"{v:.2f}"
        lines = _joined(b"BT 3 Tr /F1 ", _each(y1 - y0, lambda v: two(max(2.0, min(v, 60.0)))), b" Tf ", _each(x0, two), b" ", _each(np.repeat(height.to_numpy(), counts) - y1, two), b" Td <", _utf16(part["text"]), b"> Tj ET")
        hidden = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), lines), b"\n")
    fine, short = lambda v: f"{v:.4f}", lambda v: f"{v:.2f}"
    paint = _joined(b"q ", _each(width, fine), b" 0 0 ", _each(height, fine), b" 0 0 cm /Im0 Do Q\n", hidden)
    kinds = _each(column("kind"), lambda k: "/ColorSpace /{1} /BitsPerComponent {2} /Filter /{0} ".format(*KINDS[k]))
    two, three = pa.array(first + 1), pa.array(first + 2)
    images = _joined(n, b" 0 obj\n<< /Type /XObject /Subtype /Image /Width ", column("w"), b" /Height ", column("h"), b" ", kinds, b"/Length ", pc.binary_length(data), b" >>\nstream\n", data, b"\nendstream\nendobj\n")
    contents = _joined(two, b" 0 obj\n<< /Length ", pc.binary_length(paint), b" >>\nstream\n", paint, b"\nendstream\nendobj\n")
    pages = _joined(three, b" 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 ", _each(width, short), b" ", _each(height, short), b"] /Resources << /XObject << /Im0 ", n, b" 0 R >> /Font << /F1 3 0 R >> >> /Contents ", two, b" 0 R >>\nendobj\n")
    lengths = np.stack([pc.binary_length(x).to_numpy() for x in (images, contents, pages)], axis=1)
    whole = _joined(images, contents, pages)
    return memoryview(whole.buffers()[2]), [0, *np.cumsum(lengths.ravel(), dtype=np.int64).tolist()]


def jpeg_header(data: bytes | None) -> tuple[int, int, int, str] | None:
    """(w, h, components, sampling factors such as 2x2,1x1,1x1) of JPEG data from its frame header; None if there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(data):
                return None
            h, w, k = struct.unpack(">HHB", data[at + 5 : at + 10])
            part = [data[at + 11 + 3 * i] for i in range(k) if at + 11 + 3 * i < len(data)]
            return w, h, k, ",".join(f"{x >> 4}x{x & 15}" for x in part)
        at += 2 + n
    return None


def discover(spark, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, name and size of the files of a folder in order of path, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size")).orderBy("path")
