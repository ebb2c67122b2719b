"""Media columns: Netpbm and BMP images, area-resized tiles and difference hashes.

Images are decoded to numpy arrays (height x width x channels, 8 bits), resized
by area with integral images (the sum over any rectangle, with fractions of the
pixels at its border, from four places of a table of running sums), written as
NPY tiles of 8 x 9 cells and described by difference hashes: whether brightness
grows from each cell of the tile to the next.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm._shared import arrow_batches, beside
from lexiloom.plans.materialise import materialise

UNIT = 576
WIDTH = 24
PAD = 255
HEADER = re.compile(rb"P([1-6])((?:\s+|#[^\n]*\n)+)")
FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


class BadImage(ValueError):
    pass


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P5 or P6 of a height x width x (1 or 3) array of bytes."""
    h, w, c = pixels.shape
    return b"P%d\n%d %d\n255\n" % (5 if c == 1 else 6, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit rows, the lowest first, each filled up to four bytes."""
    h, w, _ = pixels.shape
    row = -(-w * 3 // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + h * row, 0, 0, 54, 40, w, h, 1, 24, 0, h * row, 2835, 2835, 0, 0) + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    if not (m := HEADER.match(data)):
        raise BadImage("no Netpbm header")
    kind, at, fields = int(m[1]), m.end(), []
    at = 2
    for _ in range(2 if kind in (1, 4) else 3):
        if not (f := FIELD.match(data, at)):
            raise BadImage("a Netpbm header ends early")
        fields.append(int(f[1]))
        at = f.end()
    w, h = fields[:2]
    most = fields[2] if len(fields) > 2 else 1
    if not w or not h or not 0 < most < 65536:
        raise BadImage("a Netpbm header without an image")
    channels = 3 if kind in (3, 6) else 1
    n = w * h * channels
    if kind == 1:
        values = np.array([int(x) for x in re.sub(rb"#[^\n]*\n", b"", data[at:]).replace(b" ", b"").split() for x in x.decode()], np.int64)[:n]
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[:n], np.int64)
    elif kind == 4:
        row = -(-w // 8)
        values = np.frombuffer(data, np.uint8, offset=at + 1)[: h * row]
        if len(values) < h * row:
            raise BadImage("a Netpbm raster ends early")
        values = np.unpackbits(values.reshape(h, row), axis=1)[:, :w].ravel()
    else:
        values = np.frombuffer(data[at + 1 : at + 1 + n * (1 + (most > 255))], ">u2" if most > 255 else np.uint8)
    if len(values) < n:
        raise BadImage("a Netpbm raster ends early")
    if kind in (1, 4):
        values = (1 - values) * 255
    elif most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    return values.astype(np.uint8).reshape(h, w, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54 or data[:2] != b"BM":
        raise BadImage("no BMP header")
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise BadImage("a BMP that is packed or of another depth")
    rows, row = abs(h), -(-w * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, offset=min(start, len(data)))[: rows * row]
    if len(body) < rows * row:
        raise BadImage("a BMP raster ends early")
    body = body.reshape(rows, row)
    if bits >= 24:
        out = body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        index = body if bits == 8 else np.stack([(body >> s) & ((1 << bits) - 1) for s in range(8 - bits, -1, -bits)], 2).reshape(rows, -1)
        colours = min(struct.unpack_from("<I", data, 46)[0] or 1 << bits, 1 << bits)
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        if index[:, :w].max() >= colours:
            raise BadImage("a BMP without some of its colours")
        out = palette[index[:, :w]]
    return np.ascontiguousarray(out if h < 0 else out[::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell of an even height x width grid over the image, as floats."""
    h, w, c = pixels.shape
    table = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(pixels, 0, dtype=np.float64), 1, out=table[1:, 1:])

    def at(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(n + 1) * (size / n)
        low = np.minimum(place.astype(int), size - 1)
        return low, (place - low)[:, None]

    (y, fy), (x, fx) = at(height, h), at(width, w)
    rows = table[y] + (table[y + 1] - table[y]) * fy[..., None]
    sums = rows[:, x] + (rows[:, x + 1] - rows[:, x]) * fx
    return (sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]) * (height * width / (h * w))


def npy_tile(pixels: np.ndarray, height: int = 8, width: int = 9) -> bytes:
    """The area-resized image as an NPY file of 16-bit samples, each 64 times its brightness."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(pixels, height, width) * 64).astype("<u2"), allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: bytes) -> str:
    """64 bits as hex: whether each cell of an NPY tile of 8 x 9 cells is darker than the next."""
    cells = np.load(io.BytesIO(tile), allow_pickle=False).sum(2, dtype=np.int64)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and its length without the padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data)), len(data)


def to_image(payload: bytes) -> bytes:
    """24 pixels a row and three samples a pixel; an odd number of units makes a PPM, an even one a BMP."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return encode_netpbm(pixels) if len(payload) // UNIT % 2 else encode_bmp(pixels)


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and media (the image's bytes), written to the shared folder."""
    arrow_batches(df.sparkSession)
    source = df.select(*keep, F.col(text).alias(beside(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_of(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([n for _, n in made], pa.int64()), pa.array([to_image(p) for p, _ in made], pa.binary())], names=[*keep, "n_bytes", "media"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + ["n_bytes long", "media binary"])
    return materialise(source.mapInArrow(run, schema), "media")


def describe(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What the stored images hold: the payload read back, its digests, height, width, channels, the NPY tile and its difference hash.

    An image that is null or cannot be decoded has nulls.
    """
    arrow_batches(df.sparkSession)
    source = df.select(*keep, F.col(media).alias(beside(keep)))
    nothing = (None,) * 10

    def one(data: bytes | None) -> tuple:
        if data is None:
            return nothing
        try:
            pixels = decode(data)
        except (BadImage, ValueError, struct.error):
            return nothing
        raw, tile = pixels.tobytes(), npy_tile(pixels)
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tile), *pixels.shape, tile)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "channels", "tile"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(m) for m in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=[*keep, *names])

    spark_kind = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + [f"`{n}` {spark_kind[k]}" for n, k in zip(names, kinds)]
    return source.mapInArrow(run, ", ".join(schema))


def text_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts stored as images, read back and described.

    A null text counts as empty and is one unit of padding; equal texts give
    equal images, tiles and features. Repeated rows stay, an empty table gives an
    empty result, and other columns of the table are not read.
    """
    return describe(store(df, text, (key,)), keep=(key, "n_bytes"))
