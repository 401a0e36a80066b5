"""Images: decoded by Spark's own reader, turned upright, painted and written as PNG. Reading text in them is a plugin."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``rgb`` holds height x width x 3 bytes.
SCHEMA = "path string, height int, width int, rgb binary"


def orientation(head: bytes) -> int:
    """The orientation (1 to 8) that a JPEG's Exif block tells; 1 without one."""
    at = head.find(b"Exif\0\0")
    if head[:2] != b"\xff\xd8" or at < 0:
        return 1
    tiff = head[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (first,) = struct.unpack_from(f"{order}I", tiff, 4)
        (entries,) = struct.unpack_from(f"{order}H", tiff, first)
        for k in range(entries):
            tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * k)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def upright(pixels: np.ndarray, told: int) -> np.ndarray:
    """Rows and columns as a viewer shows them."""
    turned = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: x.swapaxes(0, 1)[:, ::-1], 7: lambda x: x.swapaxes(0, 1)[::-1, ::-1], 8: lambda x: x.swapaxes(0, 1)[::-1]}
    return turned.get(told, lambda x: x)(pixels)


def png(pixels: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    height, width, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def _batch(rows: list[tuple], more: dict[str, tuple] | None = None) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    arrays, names = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "height", "width", "rgb"]
    for name, (values, kind) in (more or {}).items():
        arrays.append(pa.array(values, kind))
        names.append(name)
    return pa.record_batch(arrays, names=names)


def _pixels(row: dict) -> np.ndarray:
    return np.frombuffer(row["rgb"], np.uint8).reshape(row["height"], row["width"], 3)


def images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width, rgb`` of the images at a path; what cannot be decoded is not among them."""
    decoded = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*").withColumnRenamed("origin", "path")
    heads = spark.read.format("binaryFile").load(path).select(F.col("path").alias("p"), F.substring("content", 1, 1 << 16).alias("head"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = decoded.join(heads, same(F.col("path")) == same(F.col("p"))).select("path", "height", "width", "nChannels", "data", "head")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                x = np.repeat(x, 3, axis=2) if r["nChannels"] == 1 else x[:, :, 2::-1]  # blue comes first
                x = np.ascontiguousarray(upright(x, orientation(r["head"])))
                rows.append((r["path"], *x.shape[:2], x.tobytes()))
            yield _batch(rows)

    return both.mapInArrow(run, SCHEMA)


def with_blank(pages: DataFrame, least: float = 2.0) -> DataFrame:
    """Adds ``blank``: luminances spread less than ``least``, so there is nothing to read."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            spread = [float((_pixels(r) @ np.array([0.299, 0.587, 0.114])).std()) for r in rows]
            yield _batch([(r["path"], r["height"], r["width"], r["rgb"]) for r in rows], {"blank": ([s < least for s in spread], pa.bool_())})

    return pages.select("path", "height", "width", "rgb").mapInArrow(run, f"{SCHEMA}, blank boolean")


def paint(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pages with black rectangles over ``boxes(path, x1, y1, x2, y2)`` (ends inclusive); a box beyond the page is cut, a page without one stays."""
    own = boxes.groupBy("path").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))
    kind = "array<struct<x1:int,y1:int,x2:int,y2:int>>"
    both = pages.select("path", "height", "width", "rgb").join(own, "path", "left").withColumn("boxes", F.coalesce(F.col("boxes").cast(kind), F.array().cast(kind)))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = _pixels(r).copy()
                for b in r["boxes"]:
                    (x1, x2), (y1, y2) = sorted((b["x1"], b["x2"])), sorted((b["y1"], b["y2"]))
                    x[max(y1, 0) : max(y2 + 1, 0), max(x1, 0) : max(x2 + 1, 0)] = 0
                rows.append((r["path"], r["height"], r["width"], x.tobytes()))
            yield _batch(rows)

    return both.mapInArrow(run, SCHEMA)


def as_png(pages: DataFrame) -> DataFrame:
    """``path, png``."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([r["path"] for r in rows], pa.string()), pa.array([png(_pixels(r)) for r in rows], pa.binary())], names=["path", "png"])

    return pages.select("path", "height", "width", "rgb").mapInArrow(run, "path string, png binary")
