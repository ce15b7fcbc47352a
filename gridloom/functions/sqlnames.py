"""SQL names for the scalar functions, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

import sys
import zlib

from pyspark.sql import SparkSession

from .. import __version__
from ..types import PIXELS, SAMPLES
from .pixel import LIMITS, PALETTE, PIXEL

#: Codecs for which the engine reads and writes tiles or images: none, zlib, lzma and PNG by itself, JPEG by the JVM's library; others have no decoder here.
CODECS = {"none": 1, "deflate": 1, "deflate_no": 1, "lzma": 1, "lzma_no": 1, "jpeg": 1, "png": 1, "fax4": 0, "charls": 0, "webp": 0, "ll_webp": 0, "jp2": 0, "ll_jp2": 0}
#: Versions of the libraries below, none for those that the engine does without.
VERSIONS = {"cairo": None, "curl": None, "zlib": zlib.ZLIB_VERSION, "lzma": None, "png": None, "jpeg": None, "tiff": None, "geotiff": None, "webp": None, "charLS": None, "openJPEG": None}
STATS = "struct<sample_type:string,no_data:double,count:double,bands:array<struct<min:double,max:double,mean:double,sum_sq_diff:double,histogram:array<double>>>>"

_S = ", ".join(f"'{s}'" for s in SAMPLES)
_P = ", ".join(f"'{s}'" for s in PIXELS)
_REAL = "(p IS NOT NULL AND p.sample_type <> 'NONE')"
_RANGE = " ".join(f"WHEN '{n}' THEN v = floor(v) AND v BETWEEN {a} AND {b}" for n, (a, b, *_) in SAMPLES.items() if a is not None and "32" not in n)
_MOST = "CASE upper(s) " + " ".join(f"WHEN '{n}' THEN {m}" for n, m in LIMITS.items()) + " END"
_HEX = lambda e: "concat('#', " + ", ".join(f"lpad(lower(hex({e}.{c})), 2, '0')" for c in "rgb") + ")"
_RGB = "struct(" + ", ".join(f"cast(conv(substring(c, {i}, 2), 16, 10) AS int) AS {n}" for n, i in (("r", 2), ("g", 4), ("b", 6))) + ")"
_BAND = "CASE WHEN b >= 0 THEN try_element_at(s.bands, b + 1).{} END"
_VAR = "CASE WHEN b >= 0 AND s.count > 1 THEN try_element_at(s.bands, b + 1).sum_sq_diff / (s.count - 1) END"

#: name -> (parameters, result type, expression)
FUNCTIONS = {
    "CreatePixel": ("s string, t string, n int", PIXEL, f"CASE WHEN upper(s) IN ({_S}) AND upper(t) IN ({_P}) AND CASE upper(t) WHEN 'RGB' THEN n = 3 WHEN 'MULTIBAND' THEN n BETWEEN 2 AND 255 ELSE n = 1 END"
                    " THEN struct(upper(s) AS sample_type, upper(t) AS pixel_type, array_repeat(0D, n) AS bands, false AS transparent) END"),
    "CreatePixelNone": ("", PIXEL, "struct('NONE' AS sample_type, 'NONE' AS pixel_type, cast(array() AS array<double>) AS bands, false AS transparent)"),
    "IsPixelNone": (f"p {PIXEL}", "int", "CASE WHEN p IS NULL THEN -1 WHEN p.sample_type = 'NONE' THEN 1 ELSE 0 END"),
    "IsValidPixel": (f"p {PIXEL}, s string, n int", "int", f"CASE WHEN p IS NULL OR s IS NULL OR n IS NULL OR upper(s) NOT IN ({_S}) OR n NOT BETWEEN 1 AND 255 THEN -1 WHEN p.sample_type = 'NONE' THEN 1"
                     " WHEN p.sample_type = upper(s) AND size(p.bands) = n THEN 1 ELSE 0 END"),
    "GetPixelType": (f"p {PIXEL}", "string", f"CASE WHEN {_REAL} THEN p.pixel_type END"),
    "GetPixelSampleType": (f"p {PIXEL}", "string", f"CASE WHEN {_REAL} THEN p.sample_type END"),
    "GetPixelNumBands": (f"p {PIXEL}", "int", f"CASE WHEN {_REAL} THEN size(p.bands) END"),
    "GetPixelValue": (f"p {PIXEL}, b int", "double", f"CASE WHEN {_REAL} AND b >= 0 THEN try_element_at(p.bands, b + 1) END"),
    "SetPixelValue": (f"p {PIXEL}, b int, v double", PIXEL, f"CASE WHEN {_REAL} AND b >= 0 AND b < size(p.bands) AND v IS NOT NULL AND CASE p.sample_type {_RANGE} WHEN 'INT32' THEN v = floor(v) WHEN 'UINT32' THEN v = floor(v) ELSE true END"
                      " THEN named_struct('sample_type', p.sample_type, 'pixel_type', p.pixel_type, 'bands', transform(p.bands, (x, i) -> CASE WHEN i = b THEN v ELSE x END), 'transparent', p.transparent) END"),
    "IsTransparentPixel": (f"p {PIXEL}", "int", f"CASE WHEN {_REAL} THEN int(p.transparent) ELSE -1 END"),
    "IsOpaquePixel": (f"p {PIXEL}", "int", f"CASE WHEN {_REAL} THEN 1 - int(p.transparent) ELSE -1 END"),
    "SetTransparentPixel": (f"p {PIXEL}", PIXEL, f"CASE WHEN {_REAL} THEN named_struct('sample_type', p.sample_type, 'pixel_type', p.pixel_type, 'bands', p.bands, 'transparent', true) END"),
    "SetOpaquePixel": (f"p {PIXEL}", PIXEL, f"CASE WHEN {_REAL} THEN named_struct('sample_type', p.sample_type, 'pixel_type', p.pixel_type, 'bands', p.bands, 'transparent', false) END"),
    "PixelEquals": (f"p {PIXEL}, q {PIXEL}", "int", f"CASE WHEN {_REAL} AND {_REAL.replace('p', 'q').replace('samqle_tyqe', 'sample_type')} AND p.sample_type = q.sample_type AND p.pixel_type = q.pixel_type AND size(p.bands) = size(q.bands)"
                    " THEN int(p.bands = q.bands AND p.transparent = q.transparent) ELSE -1 END"),
    "IsValidRasterPalette": (f"p {PALETTE}, s string", "int", f"CASE WHEN p IS NULL OR s IS NULL OR upper(s) NOT IN ({_S}) THEN -1 ELSE coalesce(int(size(p) <= {_MOST}), 0) END"),
    "GetPaletteNumEntries": (f"p {PALETTE}", "int", "CASE WHEN p IS NOT NULL THEN size(p) END"),
    "GetPaletteColorEntry": (f"p {PALETTE}, i int", "string", f"CASE WHEN i >= 0 AND i < size(p) THEN {_HEX('try_element_at(p, i + 1)')} END"),
    "SetPaletteColorEntry": (f"p {PALETTE}, i int, c string", PALETTE, f"CASE WHEN i >= 0 AND i < size(p) AND c RLIKE '^#[0-9A-Fa-f]{{6}}$' THEN transform(p, (e, k) -> CASE WHEN k = i THEN {_RGB} ELSE e END) END"),
    "PaletteEquals": (f"p {PALETTE}, q {PALETTE}", "int", "CASE WHEN p IS NULL OR q IS NULL THEN -1 ELSE int(p = q) END"),
    "IsValidRasterStatistics": (f"s {STATS}, t string, n int", "int", "CASE WHEN s IS NULL OR t IS NULL OR n IS NULL THEN -1 ELSE int(s.sample_type = upper(t) AND size(s.bands) = n) END"),
    "GetRasterStatistics_NoDataPixelsCount": (f"s {STATS}", "double", "s.no_data"),
    "GetRasterStatistics_ValidPixelsCount": (f"s {STATS}", "double", "s.count"),
    "GetRasterStatistics_SampleType": (f"s {STATS}", "string", "s.sample_type"),
    "GetRasterStatistics_BandsCount": (f"s {STATS}", "int", "CASE WHEN s IS NOT NULL THEN size(s.bands) END"),
    "GetBandStatistics_Min": (f"s {STATS}, b int", "double", _BAND.format("min")),
    "GetBandStatistics_Max": (f"s {STATS}, b int", "double", _BAND.format("max")),
    "GetBandStatistics_Avg": (f"s {STATS}, b int", "double", _BAND.format("mean")),
    "GetBandStatistics_Var": (f"s {STATS}, b int", "double", _VAR),
    "GetBandStatistics_StdDev": (f"s {STATS}, b int", "double", f"sqrt({_VAR})"),
    "engine_version": ("", "string", f"'{__version__}'"),
    **{f"{name}_version": ("", "string", f"'{value}'" if value else "CAST(NULL AS STRING)") for name, value in VERSIONS.items()},
    "version": ("", "string", f"'{__version__}'"),
    "target_cpu": ("", "string", f"'{sys.platform}'"),
    **{f"has_codec_{name}": ("", "int", str(yes)) for name, yes in CODECS.items()},
}


#: Names that Spark has for functions of its own; these are known with a prefix only.
TAKEN = {"version"}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to the session's SQL, each name with a prefix where queries spell them so; returns the names."""
    made = []
    for name, (parameters, kind, body) in FUNCTIONS.items():
        if prefix or name not in TAKEN:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
            made.append(prefix + name)
    return made


def max_threads(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_max_threads(spark: SparkSession, n: int | None) -> int:
    """The number now set, 1 to 64; -1 for what is no integer."""
    if not isinstance(n, int) or isinstance(n, bool):
        return -1
    spark.conf.set("spark.sql.shuffle.partitions", str(min(64, max(1, n))))
    return max_threads(spark)
