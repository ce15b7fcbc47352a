"""Arrays of samples: delta coding, void tiles, masks, views as other types, and colours of few bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import SAMPLES

#: The grays of 1, 2 and 4 bits; one bit is black on white.
GRAYS = {
    "1-BIT": [255, 0],
    "2-BIT": [0, 86, 170, 255],
    "4-BIT": [0, 17, 34, 51, 68, 85, 102, 119, 137, 154, 171, 188, 205, 222, 239, 255],
}


def delta(values: Column) -> Column:
    """The first value, then the differences of neighbours."""
    return F.transform(values, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(values, i - 1)))


def restored(deltas: Column, kind: str = "double") -> Column:
    empty = F.array().cast(f"array<{kind}>")
    return F.aggregate(deltas, empty, lambda done, d: F.concat(done, F.array((d + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))).cast(kind))))


def void(pixels: Column, nodata: list[float]) -> Column:
    """A tile of NO-DATA pixels, band by band within each."""
    return F.flatten(F.array_repeat(F.array(*[F.lit(float(v)) for v in nodata]), pixels))


def masked(values: Column, mask: Column, nodata: float) -> Column:
    """NO-DATA where the mask is 0."""
    return F.zip_with(values, mask, lambda v, m: F.when(m != 0, v).otherwise(F.lit(nodata)))


def viewed(v: Column, sample: str) -> Column:
    """A value as another sample type: cut to whole and held within its range."""
    low, high, *_ = SAMPLES[sample]
    if low is None:
        return v.cast("float" if sample == "FLOAT" else "double")
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    return F.least(F.greatest(whole, F.lit(low)), F.lit(high)).cast("long")


def eight_bits(v: Column, sample: str) -> Column:
    """A byte of a sample: few bits as grays, 16 bits by their upper half, signed bytes shifted."""
    if sample in GRAYS:
        return F.try_element_at(F.array(*[F.lit(x) for x in GRAYS[sample]]), v.cast("int") + 1)
    if sample == "INT8":
        return (v + 128).cast("int")
    return F.floor(v / 256).cast("int") if sample == "UINT16" else v.cast("int")


def ordered(r: Column, g: Column, b: Column, a: Column, order: str) -> Column:
    """An array of channels in an order such as RGB, RGBA, ARGB, BGR or BGRA."""
    return F.array(*[{"R": r, "G": g, "B": b, "A": a}[k] for k in order])
