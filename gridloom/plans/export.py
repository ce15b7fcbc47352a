"""Exports of a coverage's window, whole or of one section: TIFF with or without georeference, PNG, ASCII and NDVI grids.

Each takes width, height, a box (minx, miny, maxx, maxy) and a resolution, and gives 1 (done), 0 (no such coverage
or section, bands that it lacks, or a resolution that no level has) or -1 (a size that the box and the resolution don't make, within 1 %).
Images are bounded by the guard of images.gathered; grids are written by Spark, a row of the grid per record.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import ndvi
from ..sources import ascii_grid, images, jpeg, raw
from .coverage import Catalog

NO_NDVI = -9999.0


def fits(width: int, height: int, box: Sequence[float], xres: float, yres: float) -> bool:
    """width and height times the resolution are the box's sides, within 1 % of them."""
    if width <= 0 or height <= 0 or xres <= 0 or yres <= 0:
        return False
    wide, high = box[2] - box[0], box[3] - box[1]
    return abs(width * xres - wide) <= wide / 100 and abs(height * yres - high) <= high / 100


def _window(catalog: Catalog, name: str, width: int, height: int, box: Sequence[float], res: float, section_id: int | None, bands: Sequence[int] | None, yres: float | None = None) -> DataFrame | int:
    yres = yres or res
    if not fits(width, height, box, res, yres):
        return -1
    c = catalog.get(name)
    if c is None or (bands is not None and not all(0 <= b < c.bands for b in bands)):
        return 0
    if section_id is not None and catalog.sections(name).where(F.col("section_id") == section_id).isEmpty():
        return 0
    level = catalog.level_of(name, res, yres)
    if level is None:
        return 0
    cells = catalog.raw(name, width, height, box[0], box[3], res, level, section_id, yres)
    return cells if bands is None else cells.withColumn("bands", F.array(*[F.element_at("bands", b + 1) for b in bands]))


def _put(catalog: Catalog, path: str, content: bytes) -> None:
    sc = catalog.spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_tiff(
    catalog: Catalog, name: str, path: str, width: int, height: int, box: Sequence[float], res: float,
    section_id: int | None = None, bands: Sequence[int] | None = None, geo: bool = True, world_file: str | None = None, compress: bool = False,
    yres: float | None = None,
) -> int:
    """geo: with GeoTIFF tags; world_file: a path for it; bands: one or three by number, all without."""
    yres = yres or res
    cells = _window(catalog, name, width, height, box, res, section_id, bands, yres)
    if isinstance(cells, int):
        return cells
    c = catalog.get(name)
    x = images.gathered(cells, width, height, c.bands if bands is None else len(bands))
    _put(catalog, path, images.encode_tiff(x, c.sample, (res, yres, box[0], box[3]) if geo else None, c.srid, compress))
    if world_file:
        _put(catalog, world_file, images.world_file(res, yres, box[0], box[3]).encode())
    return 1


def write_png(catalog: Catalog, name: str, path: str, width: int, height: int, box: Sequence[float], res: float, section_id: int | None = None, bands: Sequence[int] | None = None) -> int:
    """Of bytes alone: one band as gray, three as RGB; 0 for others."""
    cells = _window(catalog, name, width, height, box, res, section_id, bands)
    if isinstance(cells, int):
        return cells
    c = catalog.get(name)
    n = c.bands if bands is None else len(bands)
    if c.sample not in ("UINT8", "1-BIT", "2-BIT", "4-BIT") or n not in (1, 3):
        return 0
    x = images.gathered(cells, width, height, n).astype(np.uint8)
    _put(catalog, path, images.encode_png(x[:, :, 0] if n == 1 else x))
    return 1


def write_jpeg(
    catalog: Catalog, name: str, path: str, width: int, height: int, box: Sequence[float], res: float, yres: float | None = None, section_id: int | None = None, quality: int = 80, world_file: str | None = None
) -> int:
    """Of bytes alone: one band as gray, three as RGB; 0 for others."""
    yres = yres or res
    cells = _window(catalog, name, width, height, box, res, section_id, None, yres)
    if isinstance(cells, int):
        return cells
    c = catalog.get(name)
    if c.sample != "UINT8" or c.pixel not in ("GRAYSCALE", "RGB", "MULTIBAND", "DATAGRID") or c.bands not in (1, 3):
        return 0
    x = images.gathered(cells, width, height, c.bands).astype(np.uint8)
    _put(catalog, path, jpeg.encode(catalog.spark, x[:, :, 0] if c.bands == 1 else x, quality))
    if world_file:
        _put(catalog, world_file, images.world_file(res, yres, box[0], box[3]).encode())
    return 1


def write_ascii_grid(catalog: Catalog, name: str, path: str, width: int, height: int, box: Sequence[float], res: float, section_id: int | None = None, centred: bool = False, digits: int = 8) -> int:
    """Of single-band coverages; 0 for others."""
    cells = _window(catalog, name, width, height, box, res, section_id, None)
    if isinstance(cells, int):
        return cells
    c = catalog.get(name)
    if c.bands != 1:
        return 0
    ascii_grid.write(cells.withColumn("v", F.element_at("bands", 1)), path, width, height, box[0], box[1], res, c.nodata[0], centred=centred, digits=digits)
    return 1


def write_ndvi_ascii_grid(catalog: Catalog, name: str, path: str, width: int, height: int, box: Sequence[float], res: float, red: int, nir: int, section_id: int | None = None, centred: bool = False, digits: int = 8) -> int:
    """The normalised difference of two bands; NO_NDVI where the pixel is NO-DATA or both bands are 0."""
    cells = _window(catalog, name, width, height, box, res, section_id, None)
    if isinstance(cells, int):
        return cells
    c = catalog.get(name)
    if c.pixel != "MULTIBAND" or not (0 <= red < c.bands and 0 <= nir < c.bands):
        return 0
    nodata = F.array(*[F.lit(v) for v in c.nodata])
    value = F.when(F.col("bands") != nodata, ndvi(F.element_at("bands", red + 1), F.element_at("bands", nir + 1)))
    ascii_grid.write(cells.withColumn("v", F.coalesce(value, F.lit(NO_NDVI))), path, width, height, box[0], box[1], res, NO_NDVI, centred=centred, digits=digits)
    return 1


def raw_pixels(catalog: Catalog, name: str, width: int, height: int, box: Sequence[float], xres: float, yres: float | None = None, section_id: int | None = None, big_endian: bool = False) -> bytes | None:
    """The window as a buffer of samples; None where a window or level isn't there.  Rows are encoded by Spark."""
    cells = _window(catalog, name, width, height, box, xres, section_id, None, yres)
    if isinstance(cells, int) or width * height > images.MAX_SIDE**2:
        return None
    rows = raw.encode(cells, catalog.get(name).sample, big_endian)
    return b"".join(bytes(r.content) for r in sorted(rows.collect(), key=lambda r: r.out_y))
