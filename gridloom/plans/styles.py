"""Styles from SE / SLD documents, as expressions on band and attribute columns."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import vector


@dataclass
class RasterStyle:
    name: str = ""
    opacity: float = 1.0
    mono: int | None = None
    triple: tuple[int, int, int] | None = None
    contrast: str = "none"
    gamma: float = 1.0
    categories: tuple[str, list[tuple[float, str]]] | None = None
    points: list[tuple[float, str]] | None = None
    fallback: str = "#ffffff"
    relief: float | None = None
    min_scale: float | None = None
    max_scale: float | None = None
    extra: dict = field(default_factory=dict)

    def visible(self, scale: float) -> bool:
        return (self.min_scale is None or scale >= self.min_scale) and (self.max_scale is None or scale < self.max_scale)

    def colour(self, v: Column) -> Column:
        """#rrggbb of a value by the colour map."""
        if self.categories:
            base, steps = self.categories
            return F.coalesce(C.categorize(v, base, steps), F.lit(self.fallback))
        if self.points:
            rgb = lambda t: tuple(int(t[i : i + 2], 16) for i in (1, 3, 5))
            s = C.interpolate(v, [(a, rgb(t)) for a, t in self.points], rgb(self.fallback))
            return C.hex_color(s["r"], s["g"], s["b"])
        raise ValueError("the style has no colour map")

    def stretched(self, v: Column, low: Column, high: Column) -> Column:
        return C.gamma(v, low, high, self.gamma) if self.contrast == "gamma" else C.stretched(v, low, high)

    def mapped(self, v: Column) -> Column:
        """struct<r, g, b> of a value by the colour map."""
        if self.categories:
            base, steps = self.categories
            out = F.lit(base)
            for at, colour in sorted(steps):
                out = F.when(v >= at, colour).otherwise(out)
            return rgb(F.coalesce(F.when(v.isNotNull(), out), F.lit(self.fallback)))
        if self.points:
            return C.interpolate(v, [(a, channels(t)) for a, t in self.points], channels(self.fallback))
        raise ValueError("the style has no colour map")


def channels(colour: str) -> tuple[int, int, int]:
    return tuple(int(colour[i : i + 2], 16) for i in (1, 3, 5))


def rgb(colour: Column) -> Column:
    """struct<r, g, b> of #rrggbb."""
    return F.struct(*[F.conv(F.substring(colour, i, 2), 16, 10).cast("int").alias(n) for n, i in (("r", 2), ("g", 4), ("b", 6))])


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _find(root, name: str):
    return next((e for e in root.iter() if _tag(e) == name), None)


def _text(root, name: str) -> str | None:
    e = _find(root, name) if root is not None else None
    return e.text.strip() if e is not None and e.text else None


def _channel(e) -> int:
    """Bands in documents count from 1."""
    return int(_text(e, "SourceChannelName")) - 1


def parse_raster_style(document: str) -> RasterStyle:
    root = ET.fromstring(document)
    s = RasterStyle(name=_text(root, "Name") or "")
    s.opacity = float(_text(root, "Opacity") or 1)
    for limit, name in (("min_scale", "MinScaleDenominator"), ("max_scale", "MaxScaleDenominator")):
        if t := _text(root, name):
            setattr(s, limit, float(t))
    if (e := _find(root, "GrayChannel")) is not None:
        s.mono = _channel(e)
    elif _find(root, "RedChannel") is not None:
        s.triple = tuple(_channel(_find(root, f"{c}Channel")) for c in ("Red", "Green", "Blue"))
    if (e := _find(root, "ContrastEnhancement")) is not None:
        for kind in ("Normalize", "Histogram", "GammaValue"):
            if _find(e, kind) is not None:
                s.contrast = "gamma" if kind == "GammaValue" else kind.lower()
        s.gamma = float(_text(e, "GammaValue") or 1)
    if (e := _find(root, "Categorize")) is not None:
        values, thresholds = [], []
        for x in e:
            if _tag(x) == "Value":
                values.append(x.text.strip())
            elif _tag(x) == "Threshold":
                thresholds.append(float(x.text))
        s.categories = (values[0], list(zip(thresholds, values[1:], strict=True)))
        s.fallback = e.get("fallbackValue", s.fallback)
    if (e := _find(root, "Interpolate")) is not None:
        s.points = [(float(_text(p, "Data")), _text(p, "Value")) for p in e if _tag(p) == "InterpolationPoint"]
        s.fallback = e.get("fallbackValue", s.fallback)
    if (e := _find(root, "ShadedRelief")) is not None:
        s.relief = float(_text(e, "ReliefFactor") or 55)
    return s


@dataclass
class VectorRule:
    """One rule of a vector style: a filter, a range of scales, and how features are drawn."""

    name: str
    filter: ET.Element | None = None
    otherwise: bool = False
    min_scale: float | None = None
    max_scale: float | None = None
    fill: str | None = None
    fill_opacity: float = 1.0
    stroke: str | None = None
    stroke_opacity: float = 1.0
    size: int = 1

    def test(self, kinds: dict[str, str]) -> Column | None:
        """The filter over columns of given kinds (text or number); a column that isn't there matches nothing."""
        return None if self.filter is None else _condition(self.filter, kinds)


_COMPARES = {"PropertyIsEqualTo": "=", "PropertyIsNotEqualTo": "<>", "PropertyIsLessThan": "<", "PropertyIsGreaterThan": ">", "PropertyIsLessThanOrEqualTo": "<=", "PropertyIsGreaterThanOrEqualTo": ">="}


def _condition(e: ET.Element, kinds: dict[str, str]) -> Column:
    tag, parts = _tag(e), list(e)
    if tag in ("And", "Or"):
        tests = [_condition(x, kinds) for x in parts]
        out = tests[0]
        for t in tests[1:]:
            out = out & t if tag == "And" else out | t
        return out
    if tag == "Not":
        return ~_condition(parts[0], kinds)
    named = (_text(e, "PropertyName") or "").lower()
    column = next((c for c in kinds if c.lower() == named), None)
    if column is None:
        return F.lit(False)
    col, kind = F.col(f"`{column}`"), kinds[column]
    if tag in _COMPARES:
        return vector.compare(col, kind, _COMPARES[tag], _text(e, "Literal"))
    if tag == "PropertyIsBetween":
        low, high = (_text(_find(e, side), "Literal") for side in ("LowerBoundary", "UpperBoundary"))
        return vector.between(col, kind, low, high)
    if tag == "PropertyIsLike":
        return vector.like(col, _text(e, "Literal") or "", e.get("wildCard", "%"), e.get("singleChar", "_"), e.get("escapeChar", "\\"))
    if tag == "PropertyIsNull":
        return vector.is_null(col)
    raise ValueError(f"no such filter: {tag}")


def parse_vector_style(document: str) -> list[VectorRule]:
    """Rules in their order."""
    out = []
    for k, e in enumerate(x for x in ET.fromstring(document).iter() if _tag(x) == "Rule"):
        r = VectorRule(_text(e, "Name") or f"rule {k}")
        found = _find(e, "Filter")
        r.filter = None if found is None else list(found)[0]
        r.otherwise = _find(e, "ElseFilter") is not None
        for limit, name in (("min_scale", "MinScaleDenominator"), ("max_scale", "MaxScaleDenominator")):
            if t := _text(e, name):
                setattr(r, limit, float(t))
        for x in e.iter():
            if _tag(x) in ("Fill", "Stroke"):
                values = {p.get("name"): (p.text or "").strip() for p in x if _tag(p) in ("SvgParameter", "CssParameter")}
                kind = _tag(x).lower()
                setattr(r, kind, values.get(kind, "#808080" if kind == "fill" else "#000000"))
                setattr(r, f"{kind}_opacity", float(values.get(f"{kind}-opacity", 1)))
        if t := _text(e, "Size"):
            r.size = max(1, round(float(t)))
        out.append(r)
    return out


def parse_group_style(document: str) -> list[tuple[str, str | None]]:
    """(layer, style) of a group's document, from the bottom up."""
    return [(_text(e, "Name"), _text(_find(e, "NamedStyle"), "Name")) for e in ET.fromstring(document).iter() if _tag(e) == "NamedLayer"]
