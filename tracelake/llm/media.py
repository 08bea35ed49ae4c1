"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, tiled as NPY, difference-hashed.

Encoded media are bytes in a binary column; every row is decoded on its own, so memory is bounded by
the largest image of a batch.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import tidy

SIDE = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array (height, width) or (height, width, 3), 8 or 16 bits; bitmaps become 0 (black) and 255.

    Samples are scaled from their own largest value to 255 (65535 where that is over 255). ValueError for what the
    format doesn't allow: sizes of more than nine digits or more samples than the data has, samples over the largest value.
    """
    kind, at = data[:2], 2
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    sizes = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found or not re.fullmatch(rb"[0-9]{1,9}", found[1]):
            raise ValueError("not a Netpbm header")
        sizes.append(int(found[1]))
        at = found.end()
    width, height, top = *sizes[:2], (sizes[2] if len(sizes) > 2 else 1)
    planes = 3 if kind in (b"P3", b"P6") else 1
    count, left = width * height * planes, len(data) - at
    if not 0 < top < 1 << 16 or not count or count > left * (8 if kind == b"P4" else 1):
        raise ValueError("not the size or the largest value of a Netpbm image")
    shape = (height, width, planes)[: 3 if planes > 1 else 2]
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:count], np.uint8)
        if len(bits) < count or ((bits != 48) & (bits != 49)).any():
            raise ValueError("not the bits of a bitmap")
        return ((49 - bits) * 255).astype(np.uint8).reshape(shape)
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :width]) * 255).astype(np.uint8)
    wide = top > 255
    if kind in (b"P2", b"P3"):
        words = re.sub(rb"#[^\n]*\n", b"\n", data[at:]).split()[:count]
        if not all(re.fullmatch(rb"[0-9]{1,5}", w) for w in words):
            raise ValueError("not a sample")
        values = np.array(words, dtype=np.int64)
    else:
        values = np.frombuffer(data, ">u2" if wide else np.uint8, count, at + 1)
    if len(values) < count or int(values.max()) > top:
        raise ValueError("too few samples, or one over the largest value")
    if top not in (255, 65535):
        most = 65535 if wide else 255
        values = (values.astype(np.int64) * most + top // 2) // top
    return values.astype(np.uint16 if wide else np.uint8).reshape(shape)


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits to an array (height, width, 3), or (height, width) for grey palettes.

    Of bit masks (kind 3) only the usual ones of 32 bits are taken. ValueError for anything else.
    """
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height = (int.from_bytes(data[a : a + 4], "little", signed=True) for a in (10, 14, 18, 22))
    depth, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    masks = tuple(int.from_bytes(data[a : a + 4], "little") for a in (54, 58, 62))
    if depth not in (8, 24, 32) or not (packed == 0 or packed == 3 and depth == 32 and masks == (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("unsupported BMP")
    stride = (width * depth // 8 + 3) // 4 * 4
    if width <= 0 or height == 0 or start < 54 or head < 40 or stride * abs(height) > len(data) - start:
        raise ValueError("not the size of a BMP image")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if depth > 8:
        return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    colours = int.from_bytes(data[46:50], "little") or 256
    if colours > 256 or 14 + head + colours * 4 > len(data) or int(rows[:, :width].max()) >= colours:
        raise ValueError("not the palette of a BMP image")
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return (palette[:, 0] if grey else palette)[rows[:, :width]]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Grey (height, width) as 8 bits with a grey palette, colour as 24 bits."""
    height, width = pixels.shape[:2]
    colour = pixels.ndim == 3
    row = np.ascontiguousarray(pixels[::-1, :, ::-1] if colour else pixels[::-1], np.uint8).reshape(height, -1)
    body = np.pad(row, ((0, 0), (0, -row.shape[1] % 4))).tobytes()
    palette = b"" if colour else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1).copy().tobytes()
    start = 54 + len(palette)
    u4, u2 = (lambda x: x.to_bytes(4, "little", signed=True)), (lambda x: x.to_bytes(2, "little"))
    info = u4(40) + u4(width) + u4(height) + u2(1) + u2(24 if colour else 8) + u4(0) + u4(len(body)) + u4(2835) * 2 + u4(0 if colour else 256) * 2
    return b"BM" + u4(start + len(body)) + u4(0) + u4(start) + info + palette + body


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels[..., :3].astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, by differences of the integral image; cells may cut source pixels."""
    source = pixels.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        length = source.shape[axis]
        total = np.concatenate([np.zeros_like(source.take([0], axis)), source.cumsum(axis)], axis)
        edge = np.arange(size + 1) * (length / size)
        low = np.minimum(edge.astype(np.int64), length - 1)
        part = (edge - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = total.take(low, axis) + part * source.take(low, axis)
        source = np.diff(at, axis=axis) / (length / size)
    return source


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 reduction is brighter than its left neighbour."""
    small = np.rint(area_resize(grey(pixels), 8, 9) * 256).astype(np.int64)
    return int(np.packbits(small[:, 1:] > small[:, :-1]).view(">u8")[0])


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, pixels, allow_pickle=False)
    return out.getvalue()


def text_image(text: str, side: int = SIDE) -> bytes:
    """UTF-8 bytes as an 8-bit grey image of ``side`` columns: zero bytes fill the last row, or the only one."""
    data = text.encode()
    data += bytes(-len(data) % side or (0 if data else side))
    return encode_pgm(np.frombuffer(data, np.uint8).reshape(-1, side))


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an image; null text is empty. Rows are independent; no rows give none."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([text_image(t) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, media binary")


def media_columns(media: DataFrame, *, tile: int = 32) -> DataFrame:
    """Decode the binary column ``media``; all other columns pass, but for those of the names made here.

    Adds width, height, channels (int), tile (binary: the image area-resized to tile x tile grey 8-bit
    samples, in NPY format), dhash (16 hexadecimal digits), payload_sha256, payload_bytes and tail_crc32
    (of the decoded samples; the last 64) and media_sha256. Null, empty or unreadable media give nulls
    in these columns; media_sha256 is null only for null. Rows are independent, each decoded whole, in memory of its
    size; repeated rows give repeated results, no rows none.
    """
    made = [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("channels", "int", pa.int32()), ("tile", "binary", pa.binary()), ("dhash", "string", pa.string()), ("payload_sha256", "string", pa.string()), ("payload_bytes", "bigint", pa.int64()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string())]
    new = {"media", *(n for n, _, _ in made)}
    rest = [f for f in media.schema.fields if f.name not in new]
    schema = ", ".join([f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(rest)] + [f"{n} {t}" for n, t, _ in made])
    source = media.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)], "media")

    def describe(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(made)
        digest = hashlib.sha256(data).hexdigest()
        try:
            pixels = decode(data)
            if not pixels.size:
                raise ValueError("no pixels")
        except (ValueError, IndexError):
            return (*(None,) * 8, len(data), digest)
        payload = pixels.tobytes()
        small = np.clip(np.rint(area_resize(grey(pixels), tile, tile)), 0, 255).astype(np.uint8)
        return (pixels.shape[1], pixels.shape[0], 1 if pixels.ndim == 2 else pixels.shape[2], npy(small), f"{difference_hash(pixels):016x}", hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-64:]), len(data), digest)

    def run(batches):
        for batch in batches:
            rows = [describe(x.as_py()) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(made)]], names=[f"c{i}" for i in range(len(rest))] + [n for n, _, _ in made])

    return source.mapInArrow(tidy(run), schema).select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(rest)], *[n for n, _, _ in made])
