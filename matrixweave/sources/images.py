"""Images as tables: files are read by Spark and decoded where they lie.

``tiles`` rows hold a square of one channel; ``pixels`` is their exploded view.  Formats:
baseline TIFF (strips, uncompressed or deflate, 8/16/32 bits, many pages), PNG (8/16
bits, not interlaced), PGM/PPM and NPY.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256
#: TIFF tags and sample types, PNG channels by colour type: fixed values of the formats.
WIDTH, HEIGHT, BITS, PACKING, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 339
TIFF_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _tiff(data: bytes) -> np.ndarray:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at, pages = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TIFF_TYPES:
                size = struct.calcsize(TIFF_TYPES[kind]) * count
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(order + TIFF_TYPES[kind] * count, data, where)
        packing = tags.get(PACKING, (1,))[0]
        if packing not in (1, 8, 32946):
            raise ValueError(f"TIFF compression {packing} is not read")
        strips = [data[a : a + c] for a, c in zip(tags[STRIPS], tags[COUNTS])]
        raw = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
        bits, kind = tags.get(BITS, (8,))[0], {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
        h, w, c = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
        page = np.frombuffer(raw, np.dtype(f"{order}{kind}{bits // 8}"))[: h * w * c]
        pages.append(page.reshape(c, h, w) if tags.get(PLANAR, (1,))[0] == 2 else page.reshape(h, w, c).transpose(2, 0, 1))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return np.concatenate(pages)


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", chunk) if kind == b"IHDR" else head
        body += chunk if kind == b"IDAT" else b""
        at += 12 + size
    w, h, bits, colour, _, _, interlaced = head
    if interlaced or bits not in (8, 16) or colour not in PNG_CHANNELS:
        raise ValueError("only PNG of 8 or 16 bits a sample, without palette or interlacing, is read")
    step = PNG_CHANNELS[colour] * bits // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    before = np.zeros(w * step, np.int64)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind in (1, 3, 4):
            for x in range(w * step):
                a = line[x - step] if x >= step else 0
                b, c = before[x], before[x - step] if x >= step else 0
                if kind == 4:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
        elif kind == 2:
            line = (line + before) & 255
        out[y], before = line, line
    pixels = out.reshape(h, w, -1) if bits == 8 else out.reshape(h, -1).view(">u2").reshape(h, w, -1)
    return pixels.transpose(2, 0, 1)


def _netpbm(data: bytes) -> np.ndarray:
    m = re.match(rb"P([56])\s+(?:#.*\n)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    w, h, most = (int(m[i]) for i in (2, 3, 4))
    return np.frombuffer(data, ">u2" if most > 255 else np.uint8, offset=m.end()).reshape(h, w, 3 if m[1] == b"6" else 1).transpose(2, 0, 1)


def decode(data: bytes) -> np.ndarray:
    """Channels x height x width of a file's content, as 32-bit floats."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        out = _tiff(data)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        out = _png(data)
    elif data[:2] in (b"P5", b"P6"):
        out = _netpbm(data)
    elif data[:6] == b"\x93NUMPY":
        out = np.load(io.BytesIO(data), allow_pickle=False)
        out = out if out.ndim == 3 else out[None]
    else:
        raise ValueError("the content is no TIFF, PNG, PGM, PPM or NPY image")
    return np.ascontiguousarray(out, np.float32)


def read_tiles(spark: SparkSession, path: str, tile: int = TILE, layer: str = "image") -> DataFrame:
    """(path, layer, channel, ty, tx, h, w, data) of all image files under ``path``; one file is decoded in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = decode(content)
                rows = [(name, c, y // tile, x // tile, image[c, y : y + tile, x : x + tile]) for c in range(image.shape[0]) for y in range(0, image.shape[1], tile) for x in range(0, image.shape[2], tile)]
                for r in rows:
                    yield pa.record_batch([pa.array([v]) for v in (r[0], layer)] + [pa.array([v], pa.int32()) for v in (r[1], r[2], r[3], *r[4].shape)] + [pa.array([r[4].reshape(-1)], pa.list_(pa.float32()))], ["path", "layer", "channel", "ty", "tx", "h", "w", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, layer string, channel int, ty int, tx int, h int, w int, data array<float>")


def pixels(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """(path, layer, channel, y, x, v) of tiles."""
    flat = tiles.select("path", "layer", "channel", "ty", "tx", "w", F.posexplode("data").alias("i", "v"))
    return flat.select("path", "layer", "channel", F.expr(f"cast(ty * {tile} + i div w as int)").alias("y"), F.expr(f"cast(tx * {tile} + i % w as int)").alias("x"), F.col("v").cast("double").alias("v"))


def channel_files(paths: DataFrame, panel: DataFrame) -> DataFrame:
    """(path, pos, name) of the one file whose name holds ``_<channel>_`` for each row of ``panel(pos, name, channel)``; none or more is an error."""
    names = paths.select("path", F.element_at(F.split("path", "/"), -1).alias("_file"))
    found = panel.join(names, F.expr("contains(_file, concat('_', channel, '_'))"), "left")
    counts = found.groupBy("channel").agg(F.count("path").alias("n")).where("n <> 1").orderBy("channel").limit(5).collect()
    if counts:
        raise (FileNotFoundError if counts[0].n == 0 else ValueError)(f"channel {counts[0].channel} has {counts[0].n} files")
    return found.select("path", "pos", "name")


def crop(rows: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The pixels of a rectangle, as far as it lies in the image, with the rectangle's corner as origin."""
    x0, y0 = max(0, x), max(0, y)
    own = rows.where((F.col("x") >= x0) & (F.col("x") < x + w) & (F.col("y") >= y0) & (F.col("y") < y + h))
    return own.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def with_halo(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Pixels by tile (ty, tx), each also in the tiles whose border is at most ``overlap`` away; inner tells whose own it is."""
    near = lambda v: F.array_distinct(F.array(*[F.floor((F.col(v) + d) / size).cast("int") for d in (-overlap, 0, overlap)]))
    edge = rows.groupBy("sample_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    out = rows.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x"))).join(edge, "sample_id")
    out = out.where((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * size <= F.col("_h")) & (F.col("tx") * size <= F.col("_w"))).drop("_h", "_w")
    return out.withColumn("inner", (F.expr(f"y div {size}") == F.col("ty")) & (F.expr(f"x div {size}") == F.col("tx")))


def toy_image(spark: SparkSession, size: int = 96, channels: int = 5, seed: int = 0) -> DataFrame:
    """(sample_id, channel, y, x, v): stripes of fibres and hashed noise, the same for one seed however it is partitioned."""
    at = spark.range(channels * size * size).select(F.expr(f"cast(id div {size * size} as int)").alias("channel"), F.expr(f"cast(id % {size * size} div {size} as int)").alias("y"), F.expr(f"cast(id % {size} as int)").alias("x"))
    noise = F.pmod(F.xxhash64(F.lit(seed), "channel", "y", "x"), F.lit(1000)) / 1000.0
    wave = F.pow(F.sin((F.col("x") + F.col("y") * (F.col("channel") + 1) / 3) / 6), 2) * 100
    return at.select(F.lit(0).alias("sample_id"), "channel", "y", "x", (wave + noise * 10).alias("v"))
