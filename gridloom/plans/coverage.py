"""Coverages: a catalog, and for each coverage a table of sections and one of pixels, under one root.

Pixels lie in a folder per pyramid level and section (pixels/pyramid_level=L/section_id=N).  A load appends its own
folder and writes nothing else again, deletion removes folders, and queries by level and section read theirs
alone.  A section counts from when its row is written, after its pixels.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buffers import eight_bits
from ..operators import pixels, pyramid, statistics
from ..operators.codec import CODECS, encoded
from ..types import SAMPLES, allowed, default_nodata

SECTIONS = "section_id int, section_name string, width int, height int, file_path string, xres double, yres double, minx double, miny double, maxx double, maxy double"
PIXELS = "r long, c long, bands array<double>, tile_row long, tile_col long, tile_id long, pyramid_level int, section_id int"
FACTOR = 8


@dataclass
class Coverage:
    name: str
    sample: str
    pixel: str
    bands: int
    compression: str
    tile_w: int
    tile_h: int
    srid: int
    xres: float
    yres: float
    nodata: list[float] = field(default_factory=list)
    strict: bool = False
    mixed: bool = False
    title: str = ""
    abstract: str = ""
    queryable: bool = False
    copyright: str = ""
    license: str = ""
    default_bands: list[int] = field(default_factory=list)
    auto_ndvi: bool = False
    palette: list[tuple[int, int, int]] = field(default_factory=list)
    styles: dict[str, str] = field(default_factory=dict)

    def at(self, level: int) -> Coverage:
        """What pixels of a level are: bitmaps and palettes become gray or RGB above the base, where NO-DATA cells are absent."""
        if level == 0 or self.pixel not in ("MONOCHROME", "PALETTE"):
            return self
        n = 3 if self.pixel == "PALETTE" else 1
        return replace(self, pixel="RGB" if n == 3 else "GRAYSCALE", sample="UINT8", bands=n, nodata=[-1.0] * n, palette=[])


class Catalog:
    """Coverages under a root folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        sc = spark.sparkContext
        self._path = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    # -- catalog rows: one small JSON file a coverage, named by the lower-cased name

    def _file(self, name: str) -> str:
        return f"{self.root}/_catalog/{name.lower()}.json"

    def _read(self, path: str) -> str:
        """A small file's text, without a job."""
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def get(self, name: str) -> Coverage | None:
        if not isinstance(name, str) or not name or not self._fs.exists(self._path(self._file(name))):
            return None
        found = json.loads(self._read(self._file(name)))
        return Coverage(**{**found, "palette": [tuple(x) for x in found.get("palette", [])]})

    def _put(self, c: Coverage) -> None:
        out = self._fs.create(self._path(self._file(c.name)), True)
        try:
            out.write(bytearray(json.dumps(asdict(c)), "utf-8"))
        finally:
            out.close()

    def create(self, name, sample, pixel, bands, compression="NONE", tile_w=512, tile_h=512, srid=-1, xres=1.0, yres=None, nodata=None, strict=False, mixed=False, palette=()) -> int:
        """1, 0 (not allowed or there already) or -1 (invalid argument)."""
        sample, pixel, compression = (str(x).upper() for x in (sample, pixel, compression))
        if not isinstance(name, str) or not name or not isinstance(bands, int) or xres <= 0 or sample not in SAMPLES:
            return -1
        if any(t < 256 or t > 1024 or t % 16 for t in (tile_w, tile_h)):
            return -1
        if not any(p == pixel and s == sample and lo <= bands <= hi and c == compression for p, s, lo, hi, c in allowed()) or self.get(name):
            return 0
        nodata = default_nodata(pixel, sample, bands) if nodata is None else [float(x) for x in nodata]
        if len(nodata) != bands or len(palette) > 256:
            return 0
        for table in ("sections", "pixels"):
            self._fs.mkdirs(self._path(self._dir(name, table)))
        self._put(Coverage(name, sample, pixel, bands, compression, tile_w, tile_h, srid, float(xres), float(yres or xres), nodata, strict, mixed, palette=[tuple(p) for p in palette]))
        return 1

    def drop(self, name: str) -> int:
        c = self.get(name)
        if c is None:
            return 0
        self._fs.delete(self._path(self._file(name)), False)
        self._fs.delete(self._path(f"{self.root}/{c.name.lower()}"), True)
        return 1

    def copy(self, name: str, to: str | None = None, source: Catalog | None = None) -> int:
        """A whole coverage, of this catalog or of another one."""
        source, to = source or self, to or name
        c = source.get(name)
        if c is None or self.get(to):
            return 0
        for t, keys in (("pixels", ["pyramid_level", "section_id"]), ("sections", [])):
            self._fs.mkdirs(self._path(self._dir(to, t)))
            source._table(c.name, t).write.mode("append").partitionBy(*keys).parquet(self._dir(to, t))
        self._put(replace(c, name=to))
        return 1

    def _change(self, name: str, **what) -> int:
        c = self.get(name)
        if c is None:
            return 0
        self._put(replace(c, **what))
        return 1

    def set_infos(self, name: str, title: str, abstract: str, queryable: bool | None = None) -> int:
        return self._change(name, title=title, abstract=abstract, **({} if queryable is None else {"queryable": queryable}))

    def set_copyright(self, name: str, copyright: str | None = None, license: str | None = None) -> int:
        return self._change(name, **{k: v for k, v in (("copyright", copyright), ("license", license)) if v is not None})

    def set_default_bands(self, name: str, red: int, green: int, blue: int, nir: int) -> int:
        c, bands = self.get(name), [red, green, blue, nir]
        if c is None or c.pixel != "MULTIBAND" or len(set(bands)) < 4 or not all(0 <= b < c.bands for b in bands):
            return 0
        return self._change(name, default_bands=bands)

    def enable_auto_ndvi(self, name: str, on: bool) -> int:
        c = self.get(name)
        return 0 if c is None or c.pixel != "MULTIBAND" or not c.default_bands else self._change(name, auto_ndvi=bool(on))

    def is_auto_ndvi(self, name: str) -> int:
        c = self.get(name)
        return -1 if c is None or c.pixel != "MULTIBAND" or not c.default_bands else int(c.auto_ndvi)

    def set_palette(self, name: str, palette: Sequence[tuple[int, int, int]]) -> int:
        """The colours of a PALETTE coverage, 256 at most."""
        c = self.get(name)
        return 0 if c is None or c.pixel != "PALETTE" or len(palette) > 256 else self._change(name, palette=[tuple(map(int, p)) for p in palette])

    def merge_palette(self, name: str, palette: Sequence[tuple[int, int, int]]) -> list[int] | None:
        """Colours that the coverage lacks are appended; returns the number of each given colour in it, None beyond 256."""
        c = self.get(name)
        if c is None or c.pixel != "PALETTE":
            return None
        merged = list(dict.fromkeys([*c.palette, *(tuple(map(int, p)) for p in palette)]))
        if len(merged) > 256:
            return None
        if merged != c.palette:
            self._change(name, palette=merged)
        return [merged.index(tuple(map(int, p))) for p in palette]

    def set_style(self, name: str, style: str, document: str) -> int:
        """A style document that maps can name, case-insensitively."""
        c = self.get(name)
        return 0 if c is None else self._change(name, styles={**c.styles, style.lower(): document})

    # -- vector layers: Parquet tables of features with their styles

    def set_vector(self, name: str, path: str, kind: str, styles: dict[str, str] | None = None) -> int:
        """A layer of features (fid; x, y, path or rings; attributes) at a path; kind: point, line or polygon."""
        if kind not in ("point", "line", "polygon"):
            return -1
        out = self._fs.create(self._path(f"{self.root}/_vectors/{name.lower()}.json"), True)
        try:
            out.write(bytearray(json.dumps({"path": path, "kind": kind, "styles": styles or {}}), "utf-8"))
        finally:
            out.close()
        return 1

    def vector(self, name: str) -> dict | None:
        path = f"{self.root}/_vectors/{name.lower()}.json"
        return json.loads(self._read(path)) if self._fs.exists(self._path(path)) else None

    def features(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.vector(name)["path"])

    def names(self) -> list[str]:
        path = self._path(f"{self.root}/_catalog")
        return sorted(x.getPath().getName()[:-5] for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # -- data

    def _dir(self, name: str, table: str, level: int | None = None, section_id: int | None = None) -> str:
        out = f"{self.root}/{name.lower()}/{table}"
        return out if level is None else f"{out}/pyramid_level={level}" if section_id is None else f"{out}/pyramid_level={level}/section_id={section_id}"

    def _table(self, name: str, table: str) -> DataFrame:
        if table == "sections":
            return self.spark.read.schema(SECTIONS).parquet(self._dir(name, table))
        return self.spark.read.schema(PIXELS).parquet(self._dir(name, table))

    def sections(self, name: str) -> DataFrame:
        return self._table(self.get(name).name, "sections")

    def section_ids(self, name: str, section: str) -> list[int]:
        """The numbers of the sections of that name; several are ambiguous."""
        return [r[0] for r in self.sections(name).where(F.col("section_name") == section).select("section_id").orderBy("section_id").collect()]

    def pixels(self, name: str, level: int | None = None, section_id: int | None = None) -> DataFrame:
        px = self._table(self.get(name).name, "pixels")
        if level is not None:
            px = px.where(F.col("pyramid_level") == level)
        return px if section_id is None else px.where(F.col("section_id") == section_id)

    def levels(self, name: str, section_id: int | None = None) -> list[int]:
        """The pyramid levels there are, from the names of folders."""
        base = self._path(self._dir(self.get(name).name, "pixels"))
        found = [int(x.getPath().getName().partition("=")[2]) for x in self._fs.listStatus(base) if "pyramid_level=" in x.getPath().getName()] if self._fs.exists(base) else []
        if section_id is not None:
            found = [k for k in found if self._fs.exists(self._path(self._dir(name, "pixels", k, section_id)))]
        return sorted(k for k in found if list(self._fs.listStatus(self._path(self._dir(name, "pixels", k)))))

    def fits(self, c: Coverage, xres: float, yres: float) -> bool:
        tolerance = 1e-6 if c.strict else 0.01
        return c.mixed or (abs(xres - c.xres) <= c.xres * tolerance and abs(yres - c.yres) <= c.yres * tolerance)

    def load(
        self, name: str, section: str, px: DataFrame, width: int, height: int, minx: float, maxy: float, xres: float | None = None, yres: float | None = None,
        source: str = "", pyramidize: bool = False,
    ) -> int:
        """Add a section: px has r, c and bands (array<double>).  0 if its resolution isn't the coverage's or its name is taken."""
        c = self.get(name)
        if c is None or width <= 0 or height <= 0:
            return -1
        xres, yres = xres or c.xres, yres or c.yres
        if not self.fits(c, xres, yres) or self.section_ids(name, section):
            return 0
        self._append(c, [(section, width, height, source, float(xres), float(yres), float(minx), float(maxy))], px.withColumn("_at", F.lit(0)), pyramidize)
        return 1

    def _append(self, c: Coverage, rows: list[tuple], px: DataFrame, pyramidize: bool) -> list[int]:
        """Sections (name, width, height, path, xres, yres, minx, maxy) and their pixels, which _at numbers from 0 in order."""
        first = 1 + (self._table(c.name, "sections").agg(F.max("section_id")).first()[0] or 0)
        numbered = [(first + i, n, w, h, path, x, y, minx, maxy - h * y, minx + w * x, maxy) for i, (n, w, h, path, x, y, minx, maxy) in enumerate(rows)]
        for number, *_ in numbered:  # what an earlier load that failed left there
            self._fs.delete(self._path(self._dir(c.name, "pixels", 0, number)), True)
        widths = self.spark.createDataFrame([(i, r[2]) for i, r in enumerate(numbered)], "_at int, _w int")
        cells = px.join(F.broadcast(widths), "_at") if len(rows) > 1 else px.withColumn("_w", F.lit(rows[0][1]))
        cells = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("bands").cast("array<double>").alias("bands"), "_w", (F.col("_at") + first).cast("int").alias("section_id"))
        row, col = F.floor(F.col("r") / c.tile_h), F.floor(F.col("c") / c.tile_w)
        cells = cells.withColumns({"tile_row": row, "tile_col": col, "tile_id": row * F.ceil(F.col("_w") / c.tile_w) + col, "pyramid_level": F.lit(0)}).drop("_w")
        cells.write.mode("append").partitionBy("pyramid_level", "section_id").parquet(self._dir(c.name, "pixels"))
        self.spark.createDataFrame(numbered, SECTIONS).coalesce(1).write.mode("append").parquet(self._dir(c.name, "sections"))
        ids = [r[0] for r in numbered]
        if pyramidize:
            for i in ids:
                self.pyramidize(c.name, section_id=i)
        return ids

    def delete_section(self, name: str, section_id: int) -> int:
        c = self.get(name)
        if c is None or self.sections(name).where(F.col("section_id") == section_id).isEmpty():
            return 0
        # the table of sections is small: it is written anew beside itself and takes its place
        new, old = f"{self._dir(c.name, 'sections')}-{uuid.uuid4().hex}", self._path(self._dir(c.name, "sections"))
        self.sections(name).where(F.col("section_id") != section_id).write.parquet(new)
        self._fs.delete(old, True)
        self._fs.rename(self._path(new), old)
        for k in self.levels(name):
            self._fs.delete(self._path(self._dir(c.name, "pixels", k, section_id)), True)
        return 1

    def pyramidize(self, name: str, top: int = 1, section_id: int | None = None, force: bool = False, factor: int = FACTOR) -> int:
        """Levels 1 to top at 1:factor each of all sections or one; those that have a pyramid keep it unless force is set."""
        c = self.get(name)
        if c is None or (section_id is not None and self.sections(name).where(F.col("section_id") == section_id).isEmpty()):
            return 0
        if force:
            self.depyramidize(name, section_id)
        base = self.pixels(name, 0, section_id)
        if 1 in self.levels(name):
            base = base.join(self.pixels(name, 1).select("section_id").distinct(), "section_id", "left_anti")
        base, c = promoted(base, c), c.at(1)
        names = [f"b{i}" for i in range(c.bands)]
        below = base.select("section_id", "r", "c", *[F.element_at("bands", i + 1).alias(n) for i, n in enumerate(names)])
        wide = self.sections(name).agg(F.max("width")).first()[0]
        for k in range(1, top + 1):
            below = pyramid.reduced(below, factor, names, c.nodata, ["section_id"], c.sample not in ("FLOAT", "DOUBLE"))
            level = pixels.tiled(below.select("section_id", "r", "c", F.array(*names).alias("bands")), c.tile_w, c.tile_h, max(1, -(-wide // factor**k)))
            level.withColumn("pyramid_level", F.lit(k)).repartition("section_id", "tile_row").write.mode("append").partitionBy("pyramid_level", "section_id").parquet(self._dir(c.name, "pixels"))
        return 1

    def pyramidize_monolithic(self, name: str, levels: int = 1) -> int:
        """Pyramids of the whole coverage, later sections over earlier ones, as levels of section 0; an older one is replaced."""
        c = self.get(name)
        if c is None or c.mixed:
            return 0
        for k in self.levels(name, 0):
            self._fs.delete(self._path(self._dir(c.name, "pixels", k, 0)), True)
        box = statistics.extent(self.sections(name)).first()
        if box.minx is None:
            return 0
        names = [f"b{i}" for i in range(c.bands)]
        placed = self.pixels(name, 0).join(self.sections(name).select("section_id", F.col("minx").alias("sminx"), F.col("maxy").alias("smaxy")), "section_id")
        whole = lambda x: F.round(x).cast("long")
        at = placed.withColumns({"out_x": F.col("c") + whole((F.col("sminx") - box.minx) / c.xres), "out_y": F.col("r") + whole((F.lit(box.maxy) - F.col("smaxy")) / c.yres)})
        nodata = F.array(*[F.lit(v) for v in c.nodata])
        below = pixels.mosaic(at.where(F.col("bands") != nodata), F.struct("section_id", "r", "c"), ["bands"])
        below, c = promoted(below, c), c.at(1)
        names = [f"b{i}" for i in range(c.bands)]
        below = below.select(F.col("out_y").alias("r"), F.col("out_x").alias("c"), *[F.element_at("bands", i + 1).alias(n) for i, n in enumerate(names)])
        wide = round((box.maxx - box.minx) / c.xres)
        for k in range(1, levels + 1):
            below = pyramid.reduced(below, FACTOR, names, c.nodata, [], c.sample not in ("FLOAT", "DOUBLE"))
            level = pixels.tiled(below.select("r", "c", F.array(*names).alias("bands")), c.tile_w, c.tile_h, max(1, -(-wide // FACTOR**k)))
            level.write.parquet(self._dir(c.name, "pixels", k, 0))
        return 1

    def depyramidize(self, name: str, section_id: int | None = None) -> int:
        c = self.get(name)
        if c is None:
            return 0
        for k in self.levels(name):
            if k > 0:
                self._fs.delete(self._path(self._dir(c.name, "pixels", k, section_id)), True)
        return 1

    def tiles(self, name: str, level: int = 0, section_id: int | None = None, compression: str | None = None) -> DataFrame:
        """(section_id, pyramid_level, tile_id, tile_row, tile_col, payload): encoded tiles, by the coverage's compression where that has an encoder."""
        c = self.get(name).at(level)
        codec = compression or (c.compression if c.compression in CODECS else "DEFLATE")
        return encoded(self.pixels(name, level, section_id), c.sample, c.nodata, c.tile_w, c.tile_h, codec)

    def statistics(self, name: str, section_id: int | None = None) -> DataFrame:
        """(band, n, no_data, min, max, mean, ssd, k, var, stddev) of a coverage or a section, from its tiles' partials."""
        c = self.get(name)
        flat = self.pixels(name, 0, section_id).select("section_id", "tile_id", F.posexplode("bands").alias("band", "v"))
        nodata = F.element_at(F.array(*[F.lit(x) for x in c.nodata]), F.col("band") + 1)
        flat = flat.withColumn("v", F.when(F.col("v") != nodata, F.col("v")))
        parts = statistics.partials(flat, ["section_id", "tile_id", "band"])
        return statistics.variance(statistics.merged(parts, ["band"]))

    def sampled(self, name: str, points: DataFrame, level: int = 0, keys: Sequence[str] = ("x", "y")) -> DataFrame:
        """keys and bands of the points (x, y) that lie on a pixel of a level, of the section loaded last; other keys than x, y tell points apart.

        Sections are filed under the cells of a grid as wide as they are on average, so that a point finds those
        that may hold it by an equal key.
        """
        boxes = self.sections(name).select("section_id", "minx", "miny", "maxx", "maxy", "xres", "yres")
        size = boxes.agg(F.avg(F.col("maxx") - F.col("minx")).alias("w"), F.avg(F.col("maxy") - F.col("miny")).alias("h")).first()
        if size.w is None:
            return points.select(*keys).limit(0).withColumn("bands", F.lit(None).cast("array<double>"))
        key = lambda v, side: F.floor(v / F.lit(side)).cast("long")
        span = lambda a, b, side: F.explode(F.sequence(key(F.col(a), side), key(F.col(b), side)))
        filed = boxes.withColumn("gx", span("minx", "maxx", size.w)).withColumn("gy", span("miny", "maxy", size.h))
        cells = points.select("x", "y").distinct() if tuple(keys) == ("x", "y") else points.select(*keys, "x", "y")
        cells = cells.withColumns({"gx": key(F.col("x"), size.w), "gy": key(F.col("y"), size.h)})
        inside = (F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") <= F.col("maxy"))
        step = FACTOR**level
        met = cells.join(filed, ["gx", "gy"]).where(inside)
        met = met.select("section_id", *keys, pixels.trunc((F.col("maxy") - F.col("y")) / (F.col("yres") * step)).alias("r"), pixels.trunc((F.col("x") - F.col("minx")) / (F.col("xres") * step)).alias("c"))
        got = met.join(self.pixels(name, level).select("section_id", "r", "c", "bands"), ["section_id", "r", "c"])
        nodata = F.array(*[F.lit(v) for v in self.get(name).at(level).nodata])
        return got.where(F.col("bands") != nodata).groupBy(*keys).agg(F.max_by("bands", "section_id").alias("bands"))

    def pixel_at(self, name: str, points: DataFrame, level: int = 0) -> DataFrame:
        """points (x, y, ...) with the bands below them at a level, of the section loaded last; NO-DATA where there is none."""
        got = self.sampled(name, points, level).select(F.col("x").alias("_x"), F.col("y").alias("_y"), "bands")
        nodata = F.array(*[F.lit(v) for v in self.get(name).at(level).nodata])
        met = points.join(got, F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")), "left").drop("_x", "_y")
        return met.withColumn("bands", F.coalesce("bands", nodata))

    def level_of(self, name: str, xres: float, yres: float) -> int | None:
        """The level whose resolution is the given one, within the coverage's tolerance; the last such, None if there is none."""
        c = self.get(name)
        tolerance = 1e-6 if c.strict else 0.01
        found = [k for k in self.levels(name) if abs(c.xres * FACTOR**k - xres) <= xres * tolerance and abs(c.yres * FACTOR**k - yres) <= yres * tolerance]
        return found[-1] if found else None

    def best_level(self, name: str, xres: float, yres: float) -> int:
        """The coarsest level that is not coarser than asked for, else the base."""
        c = self.get(name)
        return max((k for k in self.levels(name) if c.xres * FACTOR**k <= xres and c.yres * FACTOR**k <= yres), default=0)

    def raw(self, name: str, width: int, height: int, minx: float, maxy: float, xres: float, level: int = 0, section_id: int | None = None, yres: float | None = None) -> DataFrame:
        """(out_y, out_x, bands): a window of cells, later sections over earlier ones, NO-DATA where there is none.

        Sections beside the window are not read: the join's key is the folder.  Rows and columns outside of what
        the window can need of any section are left by filters that reach the scan.
        """
        c = self.get(name).at(level)
        step, yres = FACTOR**level, yres or xres
        maxx, miny = minx + width * xres, maxy - height * yres
        boxes = self.sections(name).where(pixels.intersects(minx, miny, maxx, maxy))
        if section_id is not None:
            boxes = boxes.where(F.col("section_id") == section_id)
        row = lambda y: (F.col("maxy") - y) / (F.col("yres") * step)
        col = lambda x: (x - F.col("minx")) / (F.col("xres") * step)
        need = boxes.agg(F.min(row(F.lit(maxy))), F.max(row(F.lit(miny))), F.min(col(F.lit(minx))), F.max(col(F.lit(maxx)))).first()
        boxes = boxes.select("section_id", F.col("minx").alias("sminx"), F.col("maxy").alias("smaxy"), F.col("xres").alias("sx"), F.col("yres").alias("sy"))
        px = self.pixels(name, level, section_id)
        if need[0] is not None:
            px = px.where((F.col("r") >= int(need[0]) - 1) & (F.col("r") <= int(need[1]) + 1) & (F.col("c") >= int(need[2]) - 1) & (F.col("c") <= int(need[3]) + 1))
        px = px.join(boxes, "section_id")
        x = (F.col("sminx") + (F.col("c") + 0.5) * F.col("sx") * step - minx) / xres
        y = (F.lit(maxy) - (F.col("smaxy") - (F.col("r") + 0.5) * F.col("sy") * step)) / yres
        nodata = F.array(*[F.lit(v) for v in c.nodata])
        cells = px.where((x >= 0) & (y >= 0) & (x < width) & (y < height) & (F.col("bands") != nodata)).withColumns({"out_x": pixels.trunc(x), "out_y": pixels.trunc(y)})
        top = pixels.mosaic(cells, F.struct("section_id", "tile_id", "r", "c"), ["bands"])
        return window(self.spark, width, height).join(top, ["out_y", "out_x"], "left").withColumn("bands", F.coalesce("bands", nodata))


def window(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(out_y, out_x) of every cell."""
    across: Column = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    return spark.range(height).select(F.col("id").alias("out_y"), across.alias("out_x"))


def promoted(px: DataFrame, c: Coverage) -> DataFrame:
    """Pixels as levels above the base have them: bitmaps as gray, palette indices as their colours, without NO-DATA cells; others as they are."""
    if c.pixel not in ("MONOCHROME", "PALETTE"):
        return px
    v = F.element_at("bands", 1)
    if c.pixel == "MONOCHROME":
        return px.where(v != c.nodata[0]).withColumn("bands", F.array(eight_bits(v, "1-BIT").cast("double")))
    colours = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in c.palette]).cast("array<array<double>>")
    return px.where(v != c.nodata[0]).withColumn("bands", F.try_element_at(colours, v.cast("int") + 1)).where("bands is not null")
