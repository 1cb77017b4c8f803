"""Page-binary operators in NumPy, for pages too large to be pixel rows.

A page is one row: page, h, w and data, the gray bytes in row order. Each operator maps batches of such rows; a page is bounded, batches are
kept small by Arrow's record limit, and nothing is shuffled. A page with a null or short data gives a null result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Foreground of layers: darker than this; specks under so many pixels go; black unless channels differ by more (fixed values).
DARK, SPECK, BLACK = 170, 24, 45
SCHEMA = "page long, h int, w int, data binary"


def ellipse(k: int) -> np.ndarray:
    """Filled ellipse of k x k pixels: row y reaches sqrt(1 - (y / r)^2) of the half width, rounded."""
    r = k // 2
    y = np.arange(-r, r + 1)
    reach = np.round(r * np.sqrt(np.clip(1 - (y / max(r, 1)) ** 2, 0, 1))).astype(int)
    return np.abs(np.arange(-r, r + 1))[None, :] <= reach[:, None]


def _fold(img: np.ndarray, kernel: np.ndarray, fold, outside) -> np.ndarray:
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    pad = np.pad(img, ((ry, ry), (rx, rx)), constant_values=outside)
    out = None
    for dy, dx in np.argwhere(kernel):
        part = pad[dy : dy + img.shape[0], dx : dx + img.shape[1]]
        out = part.copy() if out is None else fold(out, part, out=out)
    return out


def dilate(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return _fold(img, kernel, np.maximum, np.zeros((), img.dtype))


def erode(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    top = np.ones((), bool) if img.dtype == bool else np.iinfo(img.dtype).max
    return _fold(img, kernel, np.minimum, top)


def opening(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return dilate(erode(img, kernel), kernel)


def gaussian(img: np.ndarray, k: int) -> np.ndarray:
    """Gaussian mean over k x k with sigma 0.3 * ((k - 1) / 2 - 1) + 0.8; the edge pixel goes on beyond the edge."""
    r, sigma = k // 2, 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    g /= g.sum()
    pad = np.pad(img.astype(np.float64), r, mode="edge")
    rows = sum(w * pad[:, i : i + img.shape[1]] for i, w in enumerate(g))
    return sum(w * rows[i : i + img.shape[0]] for i, w in enumerate(g))


def adaptive(img: np.ndarray, k: int, c: float) -> np.ndarray:
    """True for ink: not over the local Gaussian mean less c."""
    return img <= np.round(gaussian(img, k)) - c


def box_sum(img: np.ndarray, k: int) -> np.ndarray:
    """Sums over k x k windows that lie within the page, by running sums."""
    upto = np.zeros((img.shape[0] + 1, img.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(img, axis=0, dtype=np.int64), axis=1, out=upto[1:, 1:])
    return upto[k:, k:] - upto[:-k, k:] - upto[k:, :-k] + upto[:-k, :-k]


def median(img: np.ndarray, k: int) -> np.ndarray:
    """Median over k x k (k odd; 0 or 1 leaves the page), edge pixels going on; rows are taken in strips to bound memory. Large windows go by counts of the levels, whatever k."""
    if k < 2:
        return img
    r = k // 2
    pad = np.pad(img, r, mode="edge")
    out = np.empty_like(img)
    step = 16 if k < 9 else 512
    for y in range(0, len(img), step):
        strip = pad[y : min(y + step, len(img)) + 2 * r]
        if k < 9:
            out[y : y + step] = np.median(np.lib.stride_tricks.sliding_window_view(strip, (k, k)), axis=(2, 3)).astype(img.dtype)
            continue
        left = np.ones((len(strip) - 2 * r, img.shape[1]), bool)
        for level in np.unique(strip):
            now = left & (box_sum(strip <= level, k) > k * k // 2)
            out[y : y + step][now] = level
            left &= ~now
            if not left.any():
                break
    return out


def pack_bits(ink: np.ndarray) -> bytes:
    """Rows of bits, ink 0, padded to whole bytes with ones."""
    wide = np.ones((ink.shape[0], -(-ink.shape[1] // 8) * 8), np.uint8)
    wide[:, : ink.shape[1]] = ~ink
    return np.packbits(wide, axis=1).tobytes()


def unpack_bits(data: bytes, w: int, h: int) -> np.ndarray | None:
    """The ink of pack_bits(); None if the stream is short."""
    stride = -(-w // 8)
    if len(data) < stride * h:
        return None
    return np.unpackbits(np.frombuffer(data, np.uint8, stride * h).reshape(h, stride), axis=1)[:, :w] == 0


#: The first bytes of any PNG file (fixed value).
PNG = b"\x89PNG\r\n\x1a\n"


def png_chunk(kind: bytes, body: bytes = b"") -> bytes:
    """A chunk of a PNG file: length, type, body and the checksum of type and body."""
    if len(kind) != 4 or not kind.isalpha() or len(body) >= 1 << 31:
        raise ValueError(f"no PNG chunk: {kind!r} of {len(body)} bytes")
    framed = kind + body
    return len(body).to_bytes(4, "big") + framed + zlib.crc32(framed).to_bytes(4, "big")


def png_gray(rows: np.ndarray, width: int, bits: int = 1) -> bytes:
    """A grayscale PNG of rows (height x bytes a row) that hold `bits` a pixel, each row beginning on a byte."""
    height, stride = rows.shape
    if bits not in (1, 2, 4, 8) or stride != -(-width * bits // 8) or not rows.size:
        raise ValueError(f"{stride} bytes a row don't hold {width} pixels of {bits} bits")
    scan = np.zeros((height, 1 + stride), np.uint8)  # the first column says for each row that no filter is used
    scan[:, 1:] = rows
    head = np.array([width, height], ">u4").tobytes() + bytes([bits, 0, 0, 0, 0])
    return PNG + b"".join(png_chunk(k, body) for k, body in ((b"IHDR", head), (b"IDAT", zlib.compress(scan.tobytes())), (b"IEND", b"")))


def png_ink(data: bytes) -> np.ndarray:
    """Ink (black) of a 1-bit grayscale PNG whose rows use no filter, with all checksums tested."""
    at, parts = len(PNG), {}
    if data[:at] != PNG:
        raise ValueError("no PNG file")
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if png_chunk(kind, body) != data[at : at + 12 + size]:
            raise ValueError(f"chunk {kind!r} is damaged")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + size
    w, h = (int(v) for v in np.frombuffer(parts[b"IHDR"], ">u4", 2))
    scan = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, -1)
    if parts[b"IHDR"][8:10] != b"\x01\x00" or scan[:, 0].any():
        raise ValueError("not 1-bit gray, or rows with filters")
    return unpack_bits(np.ascontiguousarray(scan[:, 1:]).tobytes(), w, h)


def page_1bit(img: np.ndarray) -> bytes:
    """A text page as a 1-bit PNG through the local threshold (35, 15)."""
    packed = np.frombuffer(pack_bits(adaptive(img, 35, 15)), np.uint8)
    return png_gray(packed.reshape(len(img), -1), img.shape[1])


def split_layers(img: np.ndarray, scale: int = 2, denoise: int = 0) -> tuple[bytes, bytes]:
    """(stencil, background), both deflated: ink without specks, and the page with the widened ink whitened, smoothed and shrunk."""
    from .components import label_mask

    lab = label_mask(img < DARK)
    ids, n = np.unique(lab[lab >= 0], return_counts=True)
    ink = np.isin(lab, ids[n >= SPECK])
    back = median(np.where(dilate(ink, ellipse(5)), np.uint8(255), img), denoise)
    h, w = (s - s % scale for s in back.shape)
    small = back[:h, :w].reshape(h // scale, scale, w // scale, scale).mean(axis=(1, 3)).astype(np.uint8) if h and w else back
    return zlib.compress(pack_bits(ink), 6), zlib.compress(small.tobytes(), 6)


def on_pages(pages: DataFrame, f: Callable[[np.ndarray], np.ndarray | bytes] | None = None, make: Callable[[], Callable] | None = None) -> DataFrame:
    """f, or what make() gives in each task, applied to the page of each row; the result replaces data, and h and w if it is a page of another size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f_ = f or make()
        for b in batches:
            out = []
            for page, h, w, data in zip(*(c.to_pylist() for c in b.columns)):
                if data is None or h is None or w is None or len(data) < h * w:
                    out.append((page, h, w, None))
                    continue
                got = f_(np.frombuffer(data, np.uint8, h * w).reshape(h, w))
                out.append((page, h, w, got) if isinstance(got, bytes) else (page, *got.shape, got.astype(np.uint8).tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page", "h", "w", "data"])

    return pages.select("page", "h", "w", "data").mapInArrow(run, SCHEMA)
