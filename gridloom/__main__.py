"""Command line: python -m gridloom MODE --root FOLDER ...; one mode for each thing that a catalog does."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import calls, export, load, maps
from .plans.coverage import Catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gridloom")
    modes = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, *options: str, box: bool = False):
        m = modes.add_parser(name)
        m.add_argument("--root", required=True)
        kinds = {"bands": int, "tile_width": int, "tile_height": int, "srid": int, "resolution": float, "section": int, "width": int, "height": int, "levels": int, "band": int}
        for o in options:
            if o in ("pyramidize", "world_file", "force", "geo"):
                m.add_argument(f"--{o.replace('_', '-')}", action="store_true")
            else:
                m.add_argument(f"--{o.rstrip('?').replace('_', '-')}", required=not o.endswith("?"), type=kinds.get(o.rstrip("?"), str))
        if box:
            m.add_argument("--box", nargs=4, type=float, required=True, metavar=("MINX", "MINY", "MAXX", "MAXY"))

    mode("create", "coverage", "sample", "pixel", "bands", "compression?", "tile_width?", "tile_height?", "srid?", "resolution?")
    mode("drop", "coverage")
    mode("import", "coverage", "src", "ending?", "world_file", "pyramidize")
    mode("export", "coverage", "dst", "width", "height", "resolution", "geo", box=True)
    mode("sect-export", "coverage", "section", "dst", "width", "height", "resolution", "geo", box=True)
    mode("delete", "coverage", "section")
    mode("pyramidize", "coverage", "section?", "force")
    mode("pyrmono", "coverage", "levels?")
    mode("de-pyramidize", "coverage", "section?")
    mode("list", "coverage", "section?")
    mode("catalog")
    mode("map", "coverage", "dst", "width", "height", "style?", "background?", box=True)
    mode("histogram", "coverage", "band", "dst")
    return p


def run(spark: SparkSession, arguments: list[str]) -> tuple[int, list[str]]:
    """The result (1 for success) and lines to print."""
    a = parser().parse_args(arguments)
    cat = Catalog(spark, a.root)
    if a.mode == "create":
        return cat.create(a.coverage, a.sample, a.pixel, a.bands, a.compression or "NONE", a.tile_width or 512, a.tile_height or 512, -1 if a.srid is None else a.srid, a.resolution or 1.0), []
    if a.mode == "catalog":
        found = [cat.get(n) for n in cat.names()]
        return 1, [f"{c.name}\t{c.sample}\t{c.pixel}\t{c.bands}\t{c.compression}\t{c.tile_w}x{c.tile_h}\t{c.srid}\t{c.xres}\t{c.title}" for c in found]
    if a.mode == "drop":
        return cat.drop(a.coverage), []
    if a.mode == "import":
        return load.load_rasters_from_dir(cat, a.coverage, a.src, a.ending, a.world_file, None, a.pyramidize), []
    if cat.get(a.coverage) is None:
        return 0, [f"no such coverage: {a.coverage}"]
    if a.mode in ("export", "sect-export"):
        return export.write_tiff(cat, a.coverage, a.dst, a.width, a.height, a.box, a.resolution, getattr(a, "section", None), None, a.geo), []
    if a.mode == "delete":
        return cat.delete_section(a.coverage, a.section), []
    if a.mode == "pyramidize":
        return cat.pyramidize(a.coverage, 1, a.section, a.force), []
    if a.mode == "pyrmono":
        return cat.pyramidize_monolithic(a.coverage, a.levels or 1), []
    if a.mode == "de-pyramidize":
        return cat.depyramidize(a.coverage, a.section), []
    if a.mode == "list":
        return 1, ["\t".join(map(str, r)) for r in listed(cat, a.coverage, a.section).collect()]
    if a.mode == "map":
        content = maps.get_map_image(cat, a.coverage, a.box, a.width, a.height, a.style, "image/png", a.background or "#ffffff")
    else:
        content = calls.CALLS["getbandstatistics_histogram"](cat, {}, a.coverage, a.band)
    if content is None:
        return 0, []
    export._put(cat, a.dst, content)
    return 1, []


def listed(cat: Catalog, name: str, section_id: int | None = None):
    """(section_id, section_name, pyramid_level, tiles, cells): sections with their tiles by level."""
    tiles = cat.pixels(name, None, section_id).groupBy("section_id", "pyramid_level", "tile_id").agg(F.count("*").alias("cells"))
    levels = tiles.groupBy("section_id", "pyramid_level").agg(F.count("*").alias("tiles"), F.sum("cells").alias("cells"))
    return cat.sections(name).select("section_id", "section_name").join(levels, "section_id").orderBy("section_id", "pyramid_level")


if __name__ == "__main__":
    result, lines = run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    print("\n".join(lines))
    sys.exit(0 if result == 1 else 1)
