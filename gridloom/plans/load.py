"""Sections from files, one by path or all of a folder in one job, from buffers and from functions that make tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources import files, jpeg, raw
from ..types import SAMPLES
from .coverage import Catalog, Coverage


def _binary(catalog: Catalog, path: str, ending: str | None = None) -> DataFrame:
    found = catalog.spark.read.format("binaryFile").load(path).select("path", "content")
    return found if ending is None else found.where(F.lower("path").endswith("." + ending.lower().lstrip(".")))


def _holds(c: Coverage, header) -> bool:
    """A file's cells fit the coverage: as many bands, and a sample type that lies within the coverage's."""
    low, high, *_ = SAMPLES[c.sample]
    least, most, *_ = SAMPLES[header.sample]
    return header.bands == c.bands and (low is None or header.kind == "ascii" or (least is not None and low <= least and most <= high) or c.sample in ("1-BIT", "2-BIT", "4-BIT"))


def _pictures(catalog: Catalog, path: str, ending: str | None) -> DataFrame | None:
    """JPEG and GIF files at a path; None if it names none."""
    last = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else None
    wanted = (ending or last or "").lower().lstrip(".")
    if wanted and wanted not in jpeg.ENDINGS:
        return None
    found = jpeg.read(catalog.spark, path)
    return found.where(F.lower("path").endswith("." + wanted)) if wanted else found


def _load(catalog: Catalog, name: str, path: str, ending: str | None, with_world: bool, pyramidize: bool) -> tuple[int, int]:
    """Files loaded and files refused: unreadable, without a georeference, of other bands or resolution, or with a section's name."""
    c = catalog.get(name)
    found, pictures = _binary(catalog, path, ending), _pictures(catalog, path, ending)
    found = found.where(~F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*jpeg.ENDINGS))
    heads = files.headers(found).collect()  # a row for each file
    if pictures is not None:
        blank = dict.fromkeys(heads[0].asDict() if heads else files._NAMES)
        heads += [Row(**(blank | {"path": p.path, "kind": "jpeg", "width": p.width, "height": p.height, "bands": p.bands, "sample": "UINT8", "error": None if p.width > 0 else "no image"})) for p in pictures.drop("data").collect()]
    heads.sort(key=lambda h: h.path)
    world = files.world_files(catalog.spark, [h.path for h in heads]) if with_world else {}
    taken = {r[0] for r in catalog.sections(name).select("section_name").collect()}
    rows, paths = [], []
    for h in heads:
        geo = world.get(h.path) or ((h.xres, h.yres, h.minx, h.maxy) if h.xres is not None else None)
        section = h.path.rpartition("/")[2].rpartition(".")[0]
        if h.error or geo is None or not _holds(c, h) or not catalog.fits(c, geo[0], geo[1]) or section in taken:
            continue
        taken.add(section)
        rows.append((section, h.width, h.height, h.path, float(geo[0]), float(geo[1]), float(geo[2]), float(geo[3])))
        paths.append(h.path)
    if rows:
        numbers = catalog.spark.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "path string, _at int")
        chosen = F.broadcast(numbers.select("path"))  # a row for each file, as collected above
        cells = files.cells(found.join(chosen, "path", "left_semi"))
        if pictures is not None:
            cells = cells.unionByName(jpeg.cells(pictures.join(chosen, "path", "left_semi")))
        catalog._append(c, rows, cells.join(F.broadcast(numbers), "path"), pyramidize)
    return len(rows), len(heads) - len(rows)


def load_raster(catalog: Catalog, name: str, path: str, with_world: bool = False, force_srid: int | None = None, pyramidize: bool = False) -> int:
    """1, 0 (refused) or -1 (no such coverage).  A forced srid must be the coverage's."""
    c = catalog.get(name)
    if c is None:
        return -1
    if force_srid is not None and force_srid != c.srid:
        return 0
    return int(_load(catalog, name, path, None, with_world, pyramidize)[0] == 1)


def load_rasters_from_dir(catalog: Catalog, name: str, path: str, ending: str | None = None, with_world: bool = False, force_srid: int | None = None, pyramidize: bool = False) -> int:
    """All files of a folder, or those of an ending: 1 if any was loaded, else 0; -1 without the coverage."""
    c = catalog.get(name)
    if c is None:
        return -1
    if force_srid is not None and force_srid != c.srid:
        return 0
    return int(_load(catalog, name, path, ending, with_world, pyramidize)[0] > 0)


def import_section_raw_pixels(catalog: Catalog, name: str, section: str, width: int, height: int, content: bytes, box: Sequence[float], pyramidize: bool = False, big_endian: bool = False) -> int:
    """A section from a buffer of pixels over a box (minx, miny, maxx, maxy)."""
    c = catalog.get(name)
    if c is None or width <= 0 or height <= 0 or box[2] <= box[0] or box[3] <= box[1]:
        return -1
    if len(content) != width * height * c.bands * SAMPLES[c.sample][2]:
        return 0
    buffers = catalog.spark.createDataFrame([(bytearray(content),)], "content binary")
    px = raw.decode(buffers, width, height, c.bands, c.sample, big_endian)
    return catalog.load(name, section, px, width, height, box[0], box[3], (box[2] - box[0]) / width, (box[3] - box[1]) / height, pyramidize=pyramidize)


def load_tiles(catalog: Catalog, name: str, section: str, width: int, height: int, minx: float, maxy: float, tile: Callable[[int, int, int, int], np.ndarray], pyramidize: bool = False) -> int:
    """A section whose tiles a function makes: tile(row, column, width, height) gives (height, width, bands).  Tiles are made on the executors."""
    c = catalog.get(name)
    if c is None or width <= 0 or height <= 0:
        return -1
    tall, wide, n = c.tile_h, c.tile_w, c.bands

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = -(-width // wide)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                r, q = k // across * tall, k % across * wide
                h, w = min(tall, height - r), min(wide, width - q)
                x = np.asarray(tile(r, q, w, h), np.float64).reshape(h * w, n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1) * n, pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(r + np.repeat(np.arange(h), w)), pa.array(q + np.tile(np.arange(w), h)), lists], names=["r", "c", "bands"])

    places = catalog.spark.range(-(-width // wide) * -(-height // tall))
    return catalog.load(name, section, places.mapInArrow(run, "r long, c long, bands array<double>"), width, height, minx, maxy, pyramidize=pyramidize)


def summary(head: Row) -> str:
    """An XML summary of a file's header."""
    lines = [f"  <{tag}>{value}</{tag}>" for tag, value in (
        ("RasterFormat", head.kind), ("RasterWidth", head.width), ("RasterHeight", head.height), ("NumBands", head.bands), ("SampleType", head.sample), ("MD5", head.md5),
        ("HorizontalResolution", head.xres), ("VerticalResolution", head.yres), ("MinX", head.minx), ("MaxY", head.maxy)) if value is not None]
    return "\n".join(["<ImportedRaster>", *lines, "</ImportedRaster>"])
