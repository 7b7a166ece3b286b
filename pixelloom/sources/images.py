"""Image sources: files as rows, headers checked before pixels are decoded, EXIF orientation, a PNG codec over zlib; other formats by Spark's image source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SIDE, MAX_PIXELS = 16384, 12_000_000
_PNG = b"\x89PNG\r\n\x1a\n"
IMAGES = "path string, w int, h int, orientation int, error string, content binary"


#: What the JVM's reader has decoded: rows of pixels, channels last, blue first.
DECODED = "struct<height:int,width:int,nChannels:int,data:binary>"
#: Files that are decoded in the JVM.
_BY_JVM = "*.{jpg,jpeg,JPG,JPEG,gif,GIF,bmp,BMP}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, content, image): a batch source that splits by file. JPEG, GIF and BMP files are decoded by Spark's image source (image); PNG files by pixels_of(), from their content."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    other = F.lower("path").rlike("\\.(jpe?g|gif|bmp)$")
    plain = files.where(~other).withColumn("image", F.lit(None).cast(DECODED))
    if not files.where(other).select("path").limit(1).count():
        return plain
    decoded = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", _BY_JVM).load(path)
    decoded = decoded.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("origin"), F.struct("image.height", "image.width", "image.nChannels", "image.data").cast(DECODED).alias("image"))
    theirs = files.where(other).withColumn("origin", F.regexp_replace("path", "^file:/+", "file:/"))
    return plain.unionByName(theirs.join(decoded, "origin", "left").select("path", "content", "image"))


def pixels_of(content: bytes, image: object, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """RGB of a file, from its content (PNG) or as the source has decoded it; ValueError for what can't be read or is too large."""
    if image is not None:
        h, w, n = (int(image[c]) for c in ("height", "width", "nChannels"))
    else:
        w, h = header(content)
    if error := refusal(w, h, max_pixels):
        raise ValueError(error)
    if image is None:
        return decode_png(content)
    px = np.frombuffer(image["data"], np.uint8).reshape(h, w, n)
    if n == 1:
        return np.repeat(px, 3, axis=2)
    rgb = px[..., 2::-1]
    return (rgb.astype(np.uint32) * 257 * px[..., 3:] // 255 >> 8).astype(np.uint8) if n == 4 else np.ascontiguousarray(rgb)


def header(content: bytes) -> tuple[int, int]:
    """Width and height from a PNG's or JPEG's header; ValueError for other content."""
    if content[:8] == _PNG and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    for marker, payload in _segments(content):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(payload) >= 5:
            h, w = struct.unpack(">HH", payload[1:5])
            return w, h
    raise ValueError("unknown image format")


def refusal(w: int, h: int, max_pixels: int = MAX_PIXELS) -> str | None:
    if w <= 0 or h <= 0:
        return f"invalid dimensions {w}x{h}"
    if w > MAX_SIDE or h > MAX_SIDE:
        return f"dimensions {w}x{h} exceed limit {MAX_SIDE}px per side"
    return f"{w * h // 1_000_000} megapixels exceeds limit {max_pixels // 1_000_000} (max_pixels)" if w * h > max_pixels else None


def _segments(content: bytes) -> Iterator[tuple[int, bytes]]:
    """A JPEG's segments up to the scan."""
    if content[:2] != b"\xff\xd8":
        return
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(content):
            return
        yield marker, content[at + 4 : at + 2 + size]
        if marker == 0xDA:
            return
        at += 2 + size


def exif_block(content: bytes) -> bytes:
    return next((p[6:] for m, p in _segments(content) if m == 0xE1 and len(p) > 6 and p[:6] == b"Exif\0\0"), b"")


def orientation_of(tiff: bytes) -> int:
    """Tag 0x0112 of the first directory, 1 to 8; 0 for anything else."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 0
    magic, at = struct.unpack(order + "HI", tiff[2:8])
    if magic != 42 or at < 8 or at + 2 > len(tiff):
        return 0
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for entry in range(at + 2, at + 2 + 12 * count, 12):
        if entry + 12 > len(tiff):
            return 0
        tag, kind = struct.unpack_from(order + "HH", tiff, entry)
        if (tag, kind) == (0x0112, 3):
            (value,) = struct.unpack_from(order + "H", tiff, entry + 8)
            return value if 1 <= value <= 8 else 0
    return 0


def rotated(img: np.ndarray, orientation: int) -> np.ndarray:
    """An image set upright; rotations count counter-clockwise."""
    turns = {2: (0, True), 3: (2, False), 5: (3, True), 6: (3, False), 7: (1, True), 8: (1, False)}
    if orientation == 4:
        return img[::-1]
    n, flip = turns.get(orientation, (0, False))
    out = np.rot90(img, n)
    return out[:, ::-1] if flip else out


#: Samples a pixel by colour type, and where an interlaced image's passes begin and how they step: (x, y, dx, dy).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(content: bytes) -> np.ndarray:
    """RGB of a PNG of any depth and colour type, interlaced or not, colour premultiplied by alpha; of 16 bits the upper 8."""
    if content[:8] != _PNG:
        raise ValueError("no decoder for this format here")
    at, data, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[3] not in _SAMPLES or head[2] not in (1, 2, 4, 8, 16) or head[6] > 1 or (head[3] == 3) > (palette is not None):
        raise ValueError("not a PNG that the format allows")
    w, h, depth, kind, _, _, interlaced = head
    passes = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (_PASSES if interlaced else ((0, 0, 1, 1),))]
    passes = [p for p in passes if p[4] > 0 and p[5] > 0]
    strides = [-(-p[4] * _SAMPLES[kind] * depth // 8) for p in passes]
    total = sum((1 + stride) * p[5] for stride, p in zip(strides, passes, strict=True))
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(data), total), np.uint8)  # never more than the header says
    if len(raw) < total:
        raise ValueError("the image data ends early")
    px, begin = np.zeros((h, w, _SAMPLES[kind]), np.uint16), 0
    for (x, y, dx, dy, pw, ph), stride in zip(passes, strides, strict=True):
        rows = raw[begin : begin + (1 + stride) * ph].reshape(ph, 1 + stride)
        begin += rows.size
        px[y::dy, x::dx] = _samples(_unfiltered(rows, max(1, _SAMPLES[kind] * depth // 8)), depth, pw, _SAMPLES[kind])
    return _rgb(px, depth, kind, palette, clear)


def _samples(rows: np.ndarray, depth: int, w: int, n: int) -> np.ndarray:
    """Packed rows → samples [y, x, channel]."""
    if depth == 16:
        out = rows.reshape(len(rows), -1, 2).astype(np.uint16)
        out = out[..., 0] << 8 | out[..., 1]
    elif depth == 8:
        out = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        out = (bits * (1 << np.arange(depth - 1, -1, -1, dtype=np.uint8))).sum(axis=2)
    return out[:, : w * n].reshape(len(rows), w, n)


def _rgb(px: np.ndarray, depth: int, kind: int, palette: np.ndarray | None, clear: bytes) -> np.ndarray:
    """Samples → colours of 8 bits, premultiplied."""
    alpha = None
    if kind == 3:
        index = np.minimum(px[..., 0], len(palette) - 1)
        rgb = palette[index]
        if clear:
            alpha = np.concatenate([np.frombuffer(clear, np.uint8), np.full(256, 255, np.uint8)])[index]
    else:
        colors = px[..., :1] if kind in (0, 4) else px[..., :3]
        if clear and kind in (0, 2):
            key = np.frombuffer(clear[: 2 * colors.shape[2]], ">u2")
            alpha = np.where((colors == key).all(axis=2), 0, 255)
        eight = [c >> 8 if depth == 16 else c * (255 // ((1 << depth) - 1)) for c in (colors, px[..., -1])]
        rgb = np.repeat(eight[0], 3, axis=2) if colors.shape[2] == 1 else eight[0]
        alpha = eight[1] if kind in (4, 6) else alpha
    if alpha is not None:
        rgb = rgb.astype(np.uint32) * 257 * alpha[..., None] // 255 >> 8
    return rgb.astype(np.uint8)


def _unfiltered(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows with their filter's number first → the bytes of the image; n: bytes that a pixel's left neighbour is away."""
    kinds, body = rows[:, 0], rows[:, 1:]
    h, stride = body.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    if kinds.max(initial=0) < 3:
        out, above = np.empty_like(body), np.zeros(stride, np.uint8)
        for y in range(h):
            row = body[y]
            if kinds[y] == 1:
                row = np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
            elif kinds[y] == 2:
                row = row + above
            out[y] = above = row
        return out
    # Every pixel needs those to its left and above: all of an anti-diagonal at once.
    w = stride // n
    out = np.zeros((h + 1, w + 1, n), np.int16)
    given, kind = body.reshape(h, w, n), kinds[:, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_up = np.abs(up - corner), np.abs(left - corner)
        to_corner = np.abs(left + up - 2 * corner)
        near = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(kind[y], [np.zeros_like(left), left, up, (left + up) >> 1, near])
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, stride)


def encode_png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def inspect(files: DataFrame, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(path, w, h, orientation, error, content) of files (path, content), from their headers alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    w, h = header(content)
                    rows.append((path, w, h, orientation_of(exif_block(content)), refusal(w, h, max_pixels), content))
                except (ValueError, struct.error) as e:
                    rows.append((path, 0, 0, 0, str(e), content))
            yield pd.DataFrame(rows, columns=["path", "w", "h", "orientation", "error", "content"])

    return files.mapInPandas(run, IMAGES)


def stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New image files as they come: (path, content, modificationTime), a streaming source."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path).select("path", "content", "modificationTime")


def as_json(df: DataFrame) -> DataFrame:
    """(value): one JSON document a row, indented."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"}).alias("value"))


def as_document(df: DataFrame) -> DataFrame:
    """(value): a row's markdown, and its JSON document fenced below it, as commands and tools pass it on."""
    json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"})
    return df.select(F.concat(F.coalesce("markdown", F.lit("")), F.lit("\n```json\n"), json, F.lit("\n```\n")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.write.mode("overwrite").json(path)
