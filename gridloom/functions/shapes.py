"""Boxes, anchors, lines and rings as column functions; a path is array<struct<x, y>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed(anchor: str, x: Column, y: Column, width: Column, height: Column, xres: Column, yres: Column) -> Column:
    """struct<minx, miny, maxx, maxy> of a raster by its center or a corner (upper_left, upper_right, lower_left, lower_right)."""
    wide, high = xres * width, yres * height
    left = x - wide / 2 if anchor == "center" else x if anchor.endswith("left") else x - wide
    low = y - high / 2 if anchor == "center" else y if anchor.startswith("lower") else y - high
    return F.struct(left.alias("minx"), low.alias("miny"), (left + wide).alias("maxx"), (low + high).alias("maxy"))


def resolution(minx: Column, miny: Column, maxx: Column, maxy: Column, width: Column, height: Column) -> Column:
    """struct<xres, yres> of a raster that fills a frame; null for a frame without extent."""
    return F.when((maxx > minx) & (maxy > miny), F.struct(((maxx - minx) / width).alias("xres"), ((maxy - miny) / height).alias("yres")))


def aspect_ratio(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.try_divide(maxx - minx, maxy - miny)


def reaspected(width: int, height: int, ratio: float) -> tuple[int, int]:
    """The largest sides within width x height that have the ratio."""
    return (width, max(1, round(width / ratio))) if width / height <= ratio else (max(1, round(height * ratio)), height)


def box(path: Column) -> Column:
    """struct<minx, miny, maxx, maxy> of a path."""
    side = lambda f, n: f(F.transform(path, lambda p: p[n]))
    return F.struct(side(F.array_min, "x").alias("minx"), side(F.array_min, "y").alias("miny"), side(F.array_max, "x").alias("maxx"), side(F.array_max, "y").alias("maxy"))


def steps(path: Column) -> Column:
    """The lengths of a path's segments."""
    return F.transform(F.slice(path, 2, F.size(path)), lambda b, i: F.sqrt(F.pow(b.x - F.get(path, i).x, 2) + F.pow(b.y - F.get(path, i).y, 2)))


def length(path: Column) -> Column:
    return F.aggregate(steps(path), F.lit(0.0), lambda s, d: s + d)


def _step(s: Column, p: Column) -> Column:
    return F.sqrt(F.pow(p.x - s.x, 2) + F.pow(p.y - s.y, 2))


def _started(path: Column, **more: Column) -> Column:
    """The state of a walk at a path's first point: x, y, the way d to it, and more values, which are so computed once and not at each point."""
    at = lambda k: F.get(path, 0)[k].cast("double").alias(k)
    return F.struct(at("x"), at("y"), F.lit(0.0).alias("d"), *[v.alias(k) for k, v in more.items()])


def point_at(path: Column, way: Column) -> Column:
    """struct<x, y> that far along a path; its end beyond it.  One pass, which stands still at the first point at or beyond the way."""
    none = F.lit(None).cast("double")

    def on(s: Column, p: Column) -> Column:
        moved = F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"), (s.d + _step(s, p)).alias("d"), s.way.alias("way"), s.x.alias("px"), s.y.alias("py"), s.d.alias("pd"))
        return F.when(s.d >= s.way, s).otherwise(moved)

    def found(s: Column) -> Column:
        t = (s.way - s.pd) / (s.d - s.pd)
        between = (s.d >= s.way) & s.pd.isNotNull()
        return F.struct(F.when(between, s.px + (s.x - s.px) * t).otherwise(s.x).alias("x"), F.when(between, s.py + (s.y - s.py) * t).otherwise(s.y).alias("y"))

    return F.aggregate(F.slice(path, 2, F.size(path)), _started(path, way=way.cast("double"), px=none, py=none, pd=none), on, found)


def substring(path: Column, a: Column, b: Column) -> Column:
    """The part of a path between two ways along it.  The points between them follow one another, so one pass counts those before and those within."""
    n = lambda test: F.when(test, 1).otherwise(0)
    before, within = lambda s: s.before + n(s.d <= s.a), lambda s: s.within + n((s.d > s.a) & (s.d < s.b))

    def on(s: Column, p: Column) -> Column:
        return F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"), (s.d + _step(s, p)).alias("d"), s.a.alias("a"), s.b.alias("b"), before(s).alias("before"), within(s).alias("within"))

    zero = _started(path, a=a.cast("double"), b=b.cast("double"), before=F.lit(0), within=F.lit(0))
    inner = F.aggregate(F.slice(path, 2, F.size(path)), zero, on, lambda s: F.slice(path, before(s) + 1, within(s)))
    inner = F.transform(inner, lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y")))
    return F.concat(F.array(point_at(path, a)), inner, F.array(point_at(path, b)))


def midpoint(path: Column) -> Column:
    """Half way along a path."""
    return point_at(path, length(path) / 2)


def centroid(ring: Column) -> Column:
    """struct<x, y>: the centre of a ring's area; null without area."""
    n = F.size(ring)

    def add(s: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        cross = p.x * q.y - q.x * p.y
        return F.struct((s.a + cross).alias("a"), (s.x + (p.x + q.x) * cross).alias("x"), (s.y + (p.y + q.y) * cross).alias("y"))

    zero = F.struct(*[F.lit(0.0).alias(k) for k in "axy"])
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, add, lambda s: F.when(s.a != 0, F.struct((s.x / (3 * s.a)).alias("x"), (s.y / (3 * s.a)).alias("y"))))


def offset(path: Column, dx: Column, dy: Column) -> Column:
    return F.transform(path, lambda p: F.struct((p.x + dx).alias("x"), (p.y + dy).alias("y")))


def quoted(name: Column) -> Column:
    """An SQL name in double quotes."""
    return F.concat(F.lit('"'), F.regexp_replace(name, '"', '""'), F.lit('"'))
