"""Pixels as structs and palettes as arrays of structs: column functions with the SQL-visible results.

Predicates give 1, 0 or -1 (invalid argument); accessors give null on failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import PIXELS, SAMPLES
from .buffers import GRAYS

PIXEL = "struct<sample_type:string,pixel_type:string,bands:array<double>,transparent:boolean>"
PALETTE = "array<struct<r:int,g:int,b:int>>"
LIMITS = {"1-BIT": 2, "2-BIT": 4, "4-BIT": 16, "UINT8": 256}


def create_pixel(sample: Column, pixel: Column, bands: Column) -> Column:
    sample, pixel = F.upper(sample), F.upper(pixel)
    right = F.when(pixel == "RGB", bands == 3).when(pixel == "MULTIBAND", bands.between(2, 255)).otherwise(bands == 1)
    made = F.struct(sample.alias("sample_type"), pixel.alias("pixel_type"), F.array_repeat(F.lit(0.0), bands.cast("int")).alias("bands"), F.lit(False).alias("transparent"))
    return F.when(sample.isin(*SAMPLES) & pixel.isin(*PIXELS) & right, made)


def pixel_none() -> Column:
    return F.struct(F.lit("NONE").alias("sample_type"), F.lit("NONE").alias("pixel_type"), F.array().cast("array<double>").alias("bands"), F.lit(False).alias("transparent"))


def is_none(p: Column) -> Column:
    return F.when(p.isNull(), -1).when(p.sample_type == "NONE", 1).otherwise(0)


def _real(p: Column) -> Column:
    return p.isNotNull() & (p.sample_type != "NONE")


def is_valid(p: Column, sample: Column, bands: Column) -> Column:
    fits = (p.sample_type == F.upper(sample)) & (F.size(p.bands) == bands)
    known = F.upper(sample).isin(*SAMPLES) & bands.between(1, 255)
    return F.when(p.isNull() | sample.isNull() | bands.isNull() | ~known, -1).when(p.sample_type == "NONE", 1).otherwise(F.when(fits, 1).otherwise(0))


def pixel_type(p: Column) -> Column:
    return F.when(_real(p), p.pixel_type)


def sample_type(p: Column) -> Column:
    return F.when(_real(p), p.sample_type)


def num_bands(p: Column) -> Column:
    return F.when(_real(p), F.size(p.bands))


def value(p: Column, band: Column) -> Column:
    """Bands count from 0; null beyond them."""
    return F.when(_real(p) & (band >= 0), F.try_element_at(p.bands, band.cast("int") + 1))


def set_value(p: Column, band: Column, v: Column) -> Column:
    """Null if the band is not there, or the value not in the sample type's range; 32 bits and floats take all."""
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (a, b, *_rest) in SAMPLES.items():
        if a is not None and "32" not in name:
            low, high = F.when(p.sample_type == name, float(a)).otherwise(low), F.when(p.sample_type == name, float(b)).otherwise(high)
    whole = F.when(p.sample_type.isin("FLOAT", "DOUBLE"), True).otherwise(v.cast("double") == F.floor(v.cast("double")))
    held = F.when(low.isNull(), True).otherwise(v.cast("double").between(low, high))
    new = F.transform(p.bands, lambda x, i: F.when(i == band, v.cast("double")).otherwise(x))
    return F.when(_real(p) & (band >= 0) & (band < F.size(p.bands)) & whole & held, p.withField("bands", new))


def set_transparent(p: Column, yes: bool) -> Column:
    return F.when(_real(p), p.withField("transparent", F.lit(yes)))


def is_transparent(p: Column) -> Column:
    return F.when(~_real(p) | p.isNull(), -1).otherwise(p.transparent.cast("int"))


def is_opaque(p: Column) -> Column:
    return F.when(~_real(p) | p.isNull(), -1).otherwise(1 - p.transparent.cast("int"))


def equals(a: Column, b: Column) -> Column:
    """-1 for NONE pixels and for others of unlike types or numbers of bands."""
    alike = _real(a) & _real(b) & (a.sample_type == b.sample_type) & (a.pixel_type == b.pixel_type) & (F.size(a.bands) == F.size(b.bands))
    return F.when(F.coalesce(alike, F.lit(False)), ((a.bands == b.bands) & (a.transparent == b.transparent)).cast("int")).otherwise(-1)


def palette_valid(palette: Column, sample: Column) -> Column:
    most = F.lit(None).cast("int")
    for name, n in LIMITS.items():
        most = F.when(F.upper(sample) == name, n).otherwise(most)
    bad = palette.isNull() | sample.isNull() | ~F.upper(sample).isin(*SAMPLES)
    return F.when(bad, -1).otherwise(F.coalesce((F.size(palette) <= most).cast("int"), F.lit(0)))


def palette_size(palette: Column) -> Column:
    return F.when(palette.isNotNull(), F.size(palette))


def color(c: Column) -> Column:
    """#rrggbb of a palette entry."""
    return F.when(c.isNotNull(), F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x)), 2, "0") for x in (c.r, c.g, c.b)]))


def palette_color(palette: Column, index: Column) -> Column:
    return F.when(index >= 0, color(F.try_element_at(palette, index.cast("int") + 1)))


def parsed_color(text: Column) -> Column:
    """The struct of #rrggbb, or null."""
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def set_palette_color(palette: Column, index: Column, text: Column) -> Column:
    new = F.transform(palette, lambda e, i: F.when(i == index, parsed_color(text)).otherwise(e))
    return F.when((index >= 0) & (index < F.size(palette)) & parsed_color(text).isNotNull(), new)


def palette_equals(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), -1).otherwise((a == b).cast("int"))


def palette_index(palette: Column, text: Column) -> Column:
    """The number of the first entry of a colour #rrggbb, or null."""
    at = F.array_position(palette, parsed_color(text))
    return F.when(at > 0, (at - 1).cast("int"))


def palette_union(a: Column, b: Column) -> Column:
    """Distinct colours of a, then those of b that it lacks; null beyond 256."""
    every = F.array_union(a, b)
    return F.when(F.size(every) <= 256, every)


def palette_type(palette: Column) -> Column:
    """struct<sample_type, pixel_type> by its distinct colours: a bitmap's, a gray scale's, or a palette of so many bits."""
    colours = F.array_distinct(palette)
    n = F.size(colours)
    gray = lambda levels: F.array(*[F.struct(*[F.lit(x).alias(c) for c in "rgb"]) for x in levels])
    kind = F.when(colours == gray(GRAYS["1-BIT"]), "MONOCHROME")
    for levels in (GRAYS["2-BIT"], GRAYS["4-BIT"]):
        kind = kind.when(colours == gray(levels), "GRAYSCALE")
    every = (n == 256) & F.forall(F.sequence(F.lit(0), F.lit(255)), lambda i: (F.get(colours, i).r == i) & (F.get(colours, i).g == i) & (F.get(colours, i).b == i))
    sample = F.when(n <= 2, "1-BIT").when(n <= 4, "2-BIT").when(n <= 16, "4-BIT").otherwise("UINT8")
    return F.when(palette.isNotNull(), F.struct(sample.alias("sample_type"), kind.when(every, "GRAYSCALE").otherwise("PALETTE").alias("pixel_type")))
