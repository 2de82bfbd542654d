"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

A null value decodes to nulls; bytes that are no known image give null tile and hash and a reason in `error`.
Repeated rows give repeated results; empty tables give no rows; other columns are kept only where asked for.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table, texts_of

WIDTH = 576
TILE = 32
COMMENT = re.compile(rb"#[^\n]*")
HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey image of 8-bit samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to (h, w) or (h, w, 3), uint8 or, for maxima over 255, uint16; bitmaps become 0 (black) and 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = HEADER.match(data, at)
        if not m:
            raise ValueError("short Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, top = (*numbers, 1)[:3]
    if not 0 < top < 65536:
        raise ValueError("bad Netpbm maximum")
    if w < 1 or h < 1:
        raise ValueError("empty image")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        return (255 * (1 - np.unpackbits(rows, axis=1)[:, :w])).astype(np.uint8)
    if kind in (b"P1", b"P2", b"P3"):
        data = COMMENT.sub(b" ", data[at:])
    if kind == b"P1":
        flat = np.array([255 * (c == 48) for c in data if c in b"01"][: w * h], np.uint8)
        return flat.reshape(h, w)
    if kind in (b"P2", b"P3"):
        flat = np.array(data.split()[: w * h * depth], dtype=np.int64)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * depth, at + 1)
    if flat.size and (flat.min() < 0 or flat.max() > top):
        raise ValueError("a sample lies outside 0 to the maximum")
    out = flat.astype(np.uint16 if top > 255 else np.uint8)
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits to (h, w) where all palette entries are grey, else (h, w, 3) as red, green, blue.

    Bit fields are taken where each colour has a whole byte of 32 bits.
    """
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP form")
    if w < 1 or h == 0:
        raise ValueError("empty image")
    order = [2, 1, 0]
    if packed == 3:
        masks = struct.unpack_from("<III", data, 54)
        if bits != 32 or not set(masks) <= {0xFF << s for s in (0, 8, 16, 24)} or len(set(masks)) < 3:
            raise ValueError("unsupported BMP bit fields")
        order = [(m.bit_length() - 8) // 8 for m in masks]
    line = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, order])
    if bits < 8:
        rows = np.packbits(np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits), axis=2)[:, :, 0] >> (8 - bits)
    palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if not len(palette) or rows[:, :w].max() >= len(palette):
        raise ValueError("a pixel lies outside the palette")
    picked = palette[rows[:, :w]]
    grey = (palette == palette[:, :1]).all()
    return np.ascontiguousarray(picked[:, :, 0] if grey else picked)


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey image as 8-bit BMP with a grey palette, or (h, w, 3) as 24-bit BMP."""
    h, w = image.shape[:2]
    bits = 8 if image.ndim == 2 else 24
    line = (w * bits + 31) // 32 * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : w * bits // 8] = (image if bits == 8 else image[:, :, ::-1]).reshape(h, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).tobytes() if bits == 8 else b""
    start = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + rows.size, 0, 0, start, 40, w, h, 1, bits, 0, rows.size, 2835, 2835, 256 if bits == 8 else 0, 0)
    return head + palette + rows[::-1].tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from the integral image read at the cells' corners (between samples: linearly)."""
    grey = image.mean(axis=2) if image.ndim == 3 else image.astype(np.float64)
    h, w = grey.shape
    whole = np.zeros((h + 1, w + 1))
    np.cumsum(grey, axis=0, out=whole[1:, 1:])
    np.cumsum(whole[1:, 1:], axis=1, out=whole[1:, 1:])

    def corners(n: int, parts: int):
        at = np.arange(parts + 1) * n / parts
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    y, fy = corners(h, height)
    x, fx = corners(w, width)
    rows = whole[y] * (1 - fy)[:, None] + whole[y + 1] * fy[:, None]
    cut = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(cut, axis=0), axis=1) / (h / height * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: in an 8 x 9 area-resized image, whether each sample is darker than its right neighbour."""
    small = np.rint(area_resize(image, 8, 9) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """A side x side grey tile as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def texts_to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8, filled with bytes 255 to a positive multiple of the width, stored as PGM."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in texts_of(batch):
                raw = text.encode()
                rows = max(1, -(-len(raw) // WIDTH))
                sizes.append(len(raw))
                media.append(encode_pgm(np.frombuffer(raw.ljust(rows * WIDTH, b"\xff"), np.uint8).reshape(rows, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_tiles(df: DataFrame, key: str, column: str = "media", side: int = TILE) -> DataFrame:
    """(key, height, width, tile, dhash, error): each image decoded, resized and written as an NPY tile with its difference hash."""
    bounded_batches(df.sparkSession)
    kinds = [None, pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    names = [key, "height", "width", "tile", "dhash", "error"]

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch[column].to_pylist():
                try:
                    image = None if data is None else decode_image(data)
                    rows.append((None,) * 5 if image is None else (*image.shape[:2], npy_tile(image, side), difference_hash(image), None))
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:  # a damaged file is reported in its row
                    rows.append((None, None, None, None, str(e) or type(e).__name__))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch[key], *(pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True))], names)

    return df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, height int, width int, tile binary, dhash string, error string")


def media_digest(media: DataFrame) -> DataFrame:
    """The digest of each stored image: its payload as read back, its bytes and, as feature, difference hash and checksum of its NPY tile."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch["media"].to_pylist():
                image = decode_image(data)
                payload = image.tobytes()
                feature = f"{difference_hash(image)}-{zlib.crc32(npy_tile(image)):08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, kinds[2:], strict=True))], names)

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(texts_to_media(table(spark, sf_dir, "documents")))
