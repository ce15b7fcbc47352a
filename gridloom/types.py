"""Sample, pixel and compression types, the combinations allowed, and default NO-DATA values."""

from __future__ import annotations

#: name -> (least, largest, bytes, numpy letter); floats have no bounds.
SAMPLES = {
    "1-BIT": (0, 1, 1, "u1"), "2-BIT": (0, 3, 1, "u1"), "4-BIT": (0, 15, 1, "u1"), "INT8": (-128, 127, 1, "i1"), "UINT8": (0, 255, 1, "u1"),
    "INT16": (-32768, 32767, 2, "i2"), "UINT16": (0, 65535, 2, "u2"), "INT32": (-(2**31), 2**31 - 1, 4, "i4"), "UINT32": (0, 2**32 - 1, 4, "u4"),
    "FLOAT": (None, None, 4, "f4"), "DOUBLE": (None, None, 8, "f8"),
}
#: The codes of serialized objects.
SAMPLE_CODES = dict(zip(SAMPLES, range(0xA1, 0xAC), strict=True))
PIXELS = ("MONOCHROME", "PALETTE", "GRAYSCALE", "RGB", "MULTIBAND", "DATAGRID")
PIXEL_CODES = dict(zip(PIXELS, range(0x11, 0x17), strict=True))
COMPRESSIONS = ("NONE", "DEFLATE", "DEFLATE_NO", "LZMA", "LZMA_NO", "PNG", "GIF", "JPEG", "LOSSY_WEBP", "LOSSLESS_WEBP", "CCITTFAX4", "CHARLS", "LOSSY_JP2", "LOSSLESS_JP2")

_PLAIN = ("NONE", "DEFLATE", "DEFLATE_NO", "LZMA", "LZMA_NO")
_TIGHT = ("PNG", "CHARLS", "LOSSY_JP2", "LOSSLESS_JP2")
_WEBP = ("LOSSY_WEBP", "LOSSLESS_WEBP")


def allowed() -> list[tuple[str, str, int, int, str]]:
    """(pixel type, sample type, fewest bands, most bands, compression) of every coverage that may be made."""
    out = []

    def add(pixel, samples, low, high, codecs):
        out.extend((pixel, s, low, high, c) for s in samples for c in codecs)

    add("MONOCHROME", ["1-BIT"], 1, 1, (*_PLAIN, "PNG", "CCITTFAX4"))
    add("PALETTE", ["1-BIT", "2-BIT", "4-BIT", "UINT8"], 1, 1, (*_PLAIN, "GIF", "PNG"))
    add("GRAYSCALE", ["2-BIT", "4-BIT", "UINT8"], 1, 1, (*_PLAIN, *_TIGHT, *_WEBP, "JPEG"))
    add("RGB", ["UINT8"], 3, 3, (*_PLAIN, *_TIGHT, *_WEBP, "JPEG"))
    add("RGB", ["UINT16"], 3, 3, (*_PLAIN, *_TIGHT))
    add("MULTIBAND", ["UINT8"], 3, 4, (*_PLAIN, *_TIGHT, *_WEBP))
    add("MULTIBAND", ["UINT16"], 3, 4, (*_PLAIN, *_TIGHT))
    for low, high in ((2, 2), (5, 255)):
        add("MULTIBAND", ["UINT8", "UINT16"], low, high, _PLAIN)
    add("DATAGRID", ["UINT8", "UINT16"], 1, 1, (*_PLAIN, *_TIGHT))
    add("DATAGRID", ["INT8", "INT16", "INT32", "UINT32", "FLOAT", "DOUBLE"], 1, 1, _PLAIN)
    return out


def default_nodata(pixel: str, sample: str, bands: int) -> list[float]:
    if pixel in ("MONOCHROME", "PALETTE", "DATAGRID"):
        return [0.0]
    if pixel == "GRAYSCALE":
        return [float({"1-BIT": 1, "2-BIT": 3, "4-BIT": 15, "UINT8": 255}.get(sample, 0))]
    return [255.0 if sample == "UINT8" else 0.0] * bands


def tile_form(pixel: str, sample: str, bands: int, compression: str, level: int) -> tuple[str, str, int, str]:
    """What a valid tile of a coverage is at a pyramid level: bitmaps and palettes become gray or RGB above the base."""
    if level > 0 and bands == 1 and (pixel, sample) == ("MONOCHROME", "1-BIT"):
        return "GRAYSCALE", "UINT8", 1, "PNG"
    if level > 0 and bands == 1 and pixel == "PALETTE":
        return "RGB", "UINT8", 3, "PNG"
    return pixel, sample, bands, compression
