"""JPEG and GIF through the JVM's own image library: Spark's image source reads, the driver encodes a finished image."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images

ENDINGS = ("jpg", "jpeg", "gif")


def encode(spark: SparkSession, x: np.ndarray, quality: int = 80) -> bytes:
    """Bytes of (h, w) gray or (h, w, 3) RGB, at a quality of 1 to 100."""
    io, java = spark.sparkContext._jvm.javax.imageio, spark.sparkContext._jvm.java.io
    picture = io.ImageIO.read(java.ByteArrayInputStream(bytearray(images.encode_png(x))))
    out, writer = java.ByteArrayOutputStream(), io.ImageIO.getImageWritersByFormatName("jpg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)  # explicit
    how.setCompressionQuality(min(100, max(1, quality)) / 100)
    stream = io.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(picture, None, None), how)
    stream.close()
    writer.dispose()
    return bytes(out.toByteArray())


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bands, data) of the images at a path; data are bytes, channels from blue to red.  What isn't read has a width of -1."""
    found = spark.read.format("image").option("pathGlobFilter", "*.{" + ",".join([*ENDINGS, *(e.upper() for e in ENDINGS)]) + "}").load(path)
    return found.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("bands"), F.col("image.data").alias("data"))


def cells(found: DataFrame) -> DataFrame:
    """(path, r, c, bands) of read()'s rows, channels from red to blue."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, w, h, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                x = x[:, :, [2, 1, 0, *range(3, n)]] if n >= 3 else x
                for r in range(h):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(w + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(x[r]).reshape(-1).astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * w), pa.array(np.full(w, r)), pa.array(np.arange(w)), lists], names=["path", "r", "c", "bands"])

    return found.where("width > 0").select("path", "width", "height", "bands", "data").mapInArrow(run, "path string, r long, c long, bands array<double>")
