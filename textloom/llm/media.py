"""Media columns: Netpbm and BMP images, area resizing, NPY tiles and difference hashes.

``decode`` reads P1 to P6 and uncompressed 8- and 24-bit BMP into numpy arrays. ``area_resize`` averages
over exact boxes by an integral image in integers, so equal pixels give equal results on any machine.
``tile`` holds the small image as NPY bytes; ``difference_hash`` compares neighbouring cells of it.

``text_media`` stores each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a
binary greymap 64 samples wide, reads that form back and computes from what was read.

Defined results: null text is empty (64 zero bytes); repeated rows give equal values; null ids are
carried; an empty table gives no rows; other columns are ignored. A long text is held once per copy
that a step needs; its integral image is made in bands of rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrowtext import slices

WIDTH = 64
TILE = (8, 9)
BAND = 4096
#: Sides beyond this are taken as broken headers.
MAX_SIDE = 1 << 30
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greymap (P5) with samples 0 to 255."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8, copy=False).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.astype(np.uint8, copy=False).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP from an array of height x width x 3 (red, green, blue)."""
    height, width, _ = pixels.shape
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode(raw: bytes) -> np.ndarray:
    """height x width (grey) or height x width x 3. Raises ValueError for what it can't read, such as an image without pixels."""
    try:
        return _decode(raw)
    except (struct.error, OverflowError, IndexError) as broken:
        raise ValueError("broken header") from broken


def _decode(raw: bytes) -> np.ndarray:
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    if len(raw) > 2 and raw[:1] == b"P" and raw[1:2] in b"123456":
        return _decode_netpbm(raw)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(raw: bytes) -> np.ndarray:
    kind, at, numbers = raw[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            if raw[at : at + 1] == b"#":
                at = raw.find(b"\n", at)
                if at < 0:
                    raise ValueError("cut short in a comment")
            at += 1
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad header")
        numbers.append(int(raw[at:end]))
        at = end
    width, height, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE or not 0 < top < 65536:
        raise ValueError("no such size or depth")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = int(np.prod(shape))
    if kind < 4:
        body = b"\n".join(x.split(b"#")[0] for x in raw[at:].split(b"\n"))
        values = np.array(body.split(), np.float64) if kind > 1 else np.array([c - 48 for c in body if c in b"01"], np.float64)
        if not ((values >= 0) & (values <= top)).all():
            raise ValueError("a sample beyond the depth")
        values = values.astype(np.int64)
    elif kind == 4:
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, stride * height, at + 1)).reshape(height, stride * 8)
        values = bits[:, :width].astype(np.int64).ravel()
    else:
        wide = top > 255
        if len(raw) - at - 1 < n * (1 + wide):
            raise ValueError("cut short")
        values = np.frombuffer(raw, ">u2" if wide else np.uint8, n, at + 1)
    if len(values) < n:
        raise ValueError("cut short")
    values = values[:n].reshape(shape)
    return (1 - values) * 255 if kind in (1, 4) else values if top == 255 else values.astype(np.int64) * 255 // max(top, 1)


def _decode_bmp(raw: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", raw, 10)[0]
    header, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP")
    rows, stride = abs(height), (bits // 8 * width + 3) // 4 * 4
    if not 0 < width <= MAX_SIDE or not 0 < rows <= MAX_SIDE:
        raise ValueError("no such size")
    if len(raw) < start + rows * stride:
        raise ValueError("cut short")
    body = np.frombuffer(raw, np.uint8, rows * stride, start).reshape(rows, stride)
    body = body if height < 0 else body[::-1]
    if bits == 8:
        palette = np.frombuffer(raw, np.uint8, max(start - 14 - header, 0) // 4 * 4, 14 + header).reshape(-1, 4)
        if body[:, :width].max() >= len(palette):
            raise ValueError("a pixel beyond the palette")
        return palette[body[:, :width]][:, :, 2::-1]
    return body[:, : 3 * width].reshape(rows, width, 3)[:, :, ::-1]


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box means as uint8 (rounded half up), boxes with fractional edges weighted exactly.

    The integral image is scaled by height * width of the result, so that its values at fractional
    edges are integers; it is built in bands of rows and only the rows at box edges are kept.
    """
    if pixels.ndim == 3:
        return np.stack([area_resize(pixels[:, :, c], height, width) for c in range(pixels.shape[2])], axis=2)
    h, w = pixels.shape
    columns = np.arange(width + 1) * w
    left, part = columns // width, columns % width
    at = np.arange(height + 1) * h
    rows, rest = at // height, at % height
    edges = np.zeros((height + 1, width + 1), np.int64)
    total = np.zeros(width + 1, np.int64)
    for top in range(0, h, BAND):
        band = pixels[top : top + BAND].astype(np.int64)
        across = np.zeros((len(band), w + 2), np.int64)
        np.cumsum(band, axis=1, out=across[:, 1 : w + 1])
        across[:, w + 1] = across[:, w]
        cut = across[:, left] * width + part * (across[:, left + 1] - across[:, left])
        sums = np.zeros((len(band) + 1, width + 1), np.int64)
        np.cumsum(cut, axis=0, out=sums[1:])
        sums += total
        for i in np.flatnonzero((rows >= top) & (rows < top + len(band))):
            k = rows[i] - top
            edges[i] = sums[k] * height + rest[i] * cut[k]
        total = sums[-1]
    edges[rows >= h] = total * height
    box = np.diff(np.diff(edges, axis=0), axis=1)  # sums over boxes, times height * width
    area = h * w
    return ((2 * box + area) // (2 * area)).astype(np.uint8)


def difference_hash(small: np.ndarray) -> str:
    """Hex bits: is each cell brighter than its left neighbour."""
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(small: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, small, allow_pickle=False)
    return out.getvalue()


def read_tile(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def store_text(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, stored greymap)."""
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % WIDTH if raw else WIDTH)
    return len(raw), encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))


def features(media: bytes, height: int = TILE[0], width: int = TILE[1]) -> tuple[str, bytes]:
    """(difference hash, NPY tile) of a stored image; the tile is what the hash is taken from, read back."""
    npy = tile(area_resize(decode(media), height, width))
    return difference_hash(read_tile(npy)), npy


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: digests of the stored and the read bytes, feature and tile."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in slices(batches):
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, media = store_text(value)
                back = decode(media).tobytes()
                feature, npy = features(media)
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, npy))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SCHEMA)


def decode_column(df: DataFrame, content: str, key: str, height: int = TILE[0], width: int = TILE[1]) -> DataFrame:
    """(key, rows, columns, feature, tile) of a binary column of images; what can't be read has nulls."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(1):
                try:
                    pixels = decode(raw.as_py() or b"")
                    small = area_resize(pixels if pixels.ndim == 2 else pixels.astype(np.int64).sum(axis=2) // 3, height, width)
                    out.append((pixels.shape[0], pixels.shape[1], difference_hash(small), tile(small)))
                except ValueError:
                    out.append((None, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names=["key", "rows", "columns", "feature", "tile"])

    named = df.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return named.mapInArrow(work, f"key {named.schema['key'].dataType.simpleString()}, rows long, columns long, feature string, tile binary")
