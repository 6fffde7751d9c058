"""Operator 1: media columns. Netpbm (P2 P3 P5 P6, and P1 P4 bitmaps) and BMP (24 and 32 bits, 8 bits with a palette) are decoded
to numpy arrays, resized by area means over integral images, and written as NPY tiles with difference hashes.

Payloads that are not images are stored losslessly as images: bytes are samples, WIDTH RGB pixels a row, as binary PPM where the
number of rows is even and as BMP where it is odd; the form depends on the payload alone, so equal payloads are stored equally.

Null or empty payload: one row of blanks. Bytes that are no image, or a broken one (a raster or header that breaks off, samples
above the greatest, colours beyond the palette), decode to an error (ValueError) in the plain functions and to null columns with that
error in tile_column(). Very long payloads become tall images. Repeated rows are equal; extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, written

#: Pixels of a row; three samples each.
WIDTH = 64
ROW = 3 * WIDTH
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with blanks up to a positive multiple of ROW, and its length without them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW if data else ROW), len(data)


def store(payload: bytes) -> bytes:
    rows = len(payload) // ROW
    pixels = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH, 3)
    return encode_ppm(pixels) if rows % 2 == 0 else encode_bmp(pixels)


def encode_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, blue first, rows padded to four bytes."""
    height, width, _ = pixels.shape
    pad = -3 * width % 4
    rows = np.zeros((height, 3 * width + pad), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Samples as an array: height x width for grey, height x width x 3 for colour."""
    try:
        if data[:2] == b"BM":
            return decode_bmp(data)
        if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
            return decode_netpbm(data)
    except (OverflowError, IndexError, struct.error, MemoryError) as e:
        raise ValueError(f"a broken image: {e}") from e
    raise ValueError("neither Netpbm nor BMP")


def decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("a Netpbm header breaks off")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = *head[:2], head[2] if len(head) > 2 else 1
    if width * height == 0 or not 0 < most < 65536:
        raise ValueError("a Netpbm header is out of range")
    depth = 3 if kind in (3, 6) else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    n = width * height * depth
    if kind in (1, 2, 3):
        rest = re.sub(rb"#[^\n]*", b"", data[at:])
        found = re.findall(rb"[01]", rest) if kind == 1 else rest.split()
        if len(found) < n:
            raise ValueError("a Netpbm raster breaks off")
        values = np.array([int(x) for x in found[:n]], dtype=np.int64)
    else:
        at += 1
        size = -(-width // 8) * height if kind == 4 else n * (2 if most > 255 else 1)
        if len(data) - at < size:
            raise ValueError("a Netpbm raster breaks off")
        if kind == 4:
            values = np.unpackbits(np.frombuffer(data, np.uint8, size, at).reshape(height, -1), axis=1)[:, :width]
        else:
            values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at)
    if n and not 0 <= values.min() <= values.max() <= most:
        raise ValueError("a Netpbm sample is out of range")
    if kind in (1, 4):
        return np.where(values.reshape(shape) == 0, 255, 0).astype(np.uint8)  # 1 is black
    return values.reshape(shape).astype(np.uint16 if most > 255 else np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("a BMP header breaks off")
    begin, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing != 0 or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("a BMP of another kind")
    stride = (width * bits + 31) // 32 * 4
    if len(data) < begin + stride * abs(height):
        raise ValueError("a BMP raster breaks off")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), begin).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        if begin < 14 + head or (begin - 14 - head) % 4:
            raise ValueError("a BMP palette of another kind")
        palette = np.frombuffer(data, np.uint8, begin - 14 - head, 14 + head).reshape(-1, 4)
        return palette[rows[:, :width], 2::-1]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels.mean(axis=2)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new pixel is the mean over its area of the old ones, by an integral image read between its points too."""
    x = np.asarray(pixels, float)
    integral = np.zeros((x.shape[0] + 1, x.shape[1] + 1, *x.shape[2:]))
    integral[1:, 1:] = x.cumsum(axis=0).cumsum(axis=1)

    def at(edges, axis, table):
        low = np.minimum(edges.astype(int), table.shape[axis] - 2)
        part = (edges - low).reshape([-1 if k == axis else 1 for k in range(table.ndim)])
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    ys, xs = np.linspace(0, x.shape[0], height + 1), np.linspace(0, x.shape[1], width + 1)
    corners = at(xs, 1, at(ys, 0, integral))
    area = (x.shape[0] / height) * (x.shape[1] / width)
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / area


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: whether brightness falls from each of 8 x 9 areas to the next."""
    small = np.round(area_resize(grey(pixels), 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, pixels)
    return out.getvalue()


def tile_of(pixels: np.ndarray, side: int) -> bytes:
    """The image as an NPY tile of side x side samples of its own type."""
    return npy(np.clip(np.round(area_resize(pixels, side, side)), 0, 65535 if pixels.dtype == np.uint16 else 255).astype(pixels.dtype))


def tile(data: bytes, side: int = 32) -> tuple[bytes, str]:
    """An image file as an NPY tile, and its difference hash."""
    pixels = decode(data)
    return tile_of(pixels, side), difference_hash(pixels)


def tile_column(df: DataFrame, id_col: str, media_col: str, side: int = 32) -> DataFrame:
    """(id, height, width, channels, tile, dhash, error) of a binary column of images; tile is NPY."""

    def one(data):
        if data is None:
            return None, None, None, None, None, "null"
        try:
            pixels = decode(data)
            return *pixels.shape[:2], 1 if pixels.ndim == 2 else pixels.shape[2], *tile(data, side), None
        except ValueError as e:
            return None, None, None, None, None, str(e)

    def make():
        names = ("height", "width", "channels", "tile", "dhash", "error")
        return lambda batch: {id_col: batch.column(0)} | dict(zip(names, zip(*(one(x) for x in batch.column(1).to_pylist()), strict=True), strict=True))

    return map_batches(df, {id_col: "long", media_col: "binary"}, make, f"`{id_col}` long, height int, width int, channels int, tile binary, dhash string, error string")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media table, written to the shared folder: (doc_id, n_bytes, media) with each text stored as an image."""

    def f(batch):
        payloads = [payload_of(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [n for _, n in payloads], "media": [store(p) for p, _ in payloads]}

    return written(map_batches(df, {id_col: "long", text_col: "string"}, lambda: f, "doc_id long, n_bytes long, media binary"), "media", "zstd")


def write_tiles(media: DataFrame, side: int = 8) -> DataFrame:
    """A tile table, written to the shared folder, of what is read back from the table of store_texts(): checksums of the payload and
    of the stored form, the NPY tile of side x side samples and the difference hash."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash")

    def one(data):
        pixels = decode(data)
        payload = pixels.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), tile_of(pixels, side), difference_hash(pixels)

    def f(batch):
        return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | dict(zip(names, zip(*(one(x) for x in batch.column(2).to_pylist()), strict=True), strict=True))

    table = map_batches(media, {"doc_id": "long", "n_bytes": "long", "media": "binary"}, lambda: f, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string")
    return written(table, "tiles", "zstd")


def media_features(tiles: DataFrame) -> DataFrame:
    """The columns of the table of write_tiles() with a feature of each tile read back: its difference hash, that of the whole image
    and the mean colours of its quarters; tile_sha256 is the digest of the NPY file."""
    names = ("feature", "tile_sha256")

    def one(data, whole):
        pixels = np.load(io.BytesIO(data))
        means = np.round(area_resize(pixels, 2, 2)).astype(np.uint8).tobytes().hex()
        return f"{difference_hash(pixels)}:{whole}:{means}", hashlib.sha256(data).hexdigest()

    kept = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string"}

    def f(batch):
        *own, data, whole = batch.columns
        made = zip(*(one(d, w) for d, w in zip(data.to_pylist(), whole.to_pylist(), strict=True)), strict=True)
        return dict(zip(kept, own, strict=True)) | dict(zip(names, made, strict=True))

    return map_batches(tiles, kept | {"tile": "binary", "dhash": "string"}, lambda: f, ", ".join(f"{c} {t}" for c, t in kept.items()) + ", feature string, tile_sha256 string")
