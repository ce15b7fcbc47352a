"""Raster files by what they hold: TIFF, PNG and ASCII grids, told by their first bytes.

A file is one task's work: its header gives a row, its cells follow a row of the raster at a time.
"""

from __future__ import annotations

import hashlib
import lzma
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import images

#: The endings of world files by those of images.
WORLD = {"tif": ("tfw", "tifw", "wld"), "tiff": ("tfw", "tifw", "wld"), "png": ("pgw", "pngw", "wld"), "jpg": ("jgw", "jpgw", "wld"), "jpeg": ("jgw", "jpegw", "wld"), "gif": ("gfw", "wld"), "asc": ()}
HEADER = "path string, kind string, bytes long, md5 string, width long, height long, bands int, sample string, xres double, yres double, minx double, maxy double, error string"
_NAMES = [x.split()[0] for x in HEADER.split(", ")]
_SAMPLES = {"u1": "UINT8", "i1": "INT8", "u2": "UINT16", "i2": "INT16", "u4": "UINT32", "i4": "INT32", "f4": "FLOAT", "f8": "DOUBLE"}
_GRID = re.compile(rb"\s*(?:ncols|nrows|[xy]ll(?:corner|center)|cellsize|nodata_value)\s", re.I)


def decode_ascii(content: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """(h, w, 1) and x and y resolution, least x, largest y of an ASCII grid."""
    head: dict[str, float] = {}
    centred, at = set(), 0
    while len(head) < 6 and _GRID.match(content, at):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        key, value = content[at:end].split()
        key = key.decode().lower()
        if key.replace("center", "corner") in head:
            raise ValueError(f"twice in the header: {key}")
        if "center" in key:
            centred.add(key[0])
        head[key.replace("center", "corner")] = float(value)
        at = end + 1
    if not {"ncols", "nrows", "xllcorner", "yllcorner", "cellsize"} <= set(head):
        raise ValueError("the header is short")
    w, h, res = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    x = np.array(content[at:].split(), np.float64)
    if len(x) != w * h:
        raise ValueError(f"{len(x)} cells where {w * h} are due")
    left, low = head["xllcorner"] - res / 2 * ("x" in centred), head["yllcorner"] - res / 2 * ("y" in centred)
    return x.reshape(h, w, 1), (res, res, left, low + h * res)


def decode(content: bytes) -> tuple[str, np.ndarray, tuple[float, float, float, float] | None]:
    """Kind, cells (h, w, bands) and georeference of a file; ValueError for what is none of these."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        x, tags = images.decode_tiff(content)
        return "tiff", x, images.georeference(tags)
    if content[:8] == images.PNG:
        return "png", images.decode_png(content), None
    if _GRID.match(content):
        x, geo = decode_ascii(content)
        return "ascii", x, geo
    raise ValueError("no TIFF, PNG or ASCII grid")


def _failed(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def headers(files: DataFrame) -> DataFrame:
    """A row of HEADER for each binaryFile row (path, content); `error` says why a file isn't read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(_NAMES) | {"path": path, "bytes": len(content), "md5": hashlib.md5(content).hexdigest()}
                try:
                    kind, x, geo = decode(content)
                    row |= {"kind": kind, "height": x.shape[0], "width": x.shape[1], "bands": x.shape[2], "sample": _SAMPLES[x.dtype.kind + str(x.dtype.itemsize)]}
                    row |= dict(zip(("xres", "yres", "minx", "maxy"), geo or (None,) * 4, strict=True))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, lzma.LZMAError) as error:
                    row["error"] = _failed(error)
                rows.append(row)
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[t]) for n, t in (x.split() for x in HEADER.split(", "))]))

    return files.select("path", "content").mapInArrow(run, HEADER)


def cells(files: DataFrame) -> DataFrame:
    """(path, r, c, bands) of binaryFile rows; a file that isn't read raises."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, x, _ = decode(content)
                h, w, bands = x.shape
                for r in range(h):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(w + 1) * bands, pa.int32()), pa.array(x[r].reshape(-1).astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * w), pa.array(np.full(w, r)), pa.array(np.arange(w)), lists], names=["path", "r", "c", "bands"])

    return files.select("path", "content").mapInArrow(run, "path string, r long, c long, bands array<double>")


def world_files(spark: SparkSession, paths: list[str]) -> dict[str, tuple[float, float, float, float]]:
    """The georeference of images that have a world file beside them, by path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for path in paths:
        stem, _, ending = path.rpartition(".")
        for other in WORLD.get(ending.lower(), ()):
            where = jvm.org.apache.hadoop.fs.Path(f"{stem}.{other}")
            if where.getFileSystem(conf).exists(where):
                found[path] = images.parse_world_file(spark.read.text(f"{stem}.{other}", wholetext=True).first()[0])
                break
    return found
