"""Scalar functions: the results that their contracts name, null and invalid arguments included."""

import pytest

from gridloom.functions import sqlnames


@pytest.fixture(scope="module")
def sql(spark):
    sqlnames.register(spark)
    return lambda e: spark.sql(f"SELECT {e} AS x").first()[0]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("CreatePixel(NULL, 'GRAYSCALE', 1)", None),
        ("CreatePixel('UINT8', 'RGB', 1)", None),
        ("CreatePixel('UINT8', 'MULTIBAND', 1)", None),
        ("GetPixelNumBands(CreatePixel('UINT8', 'RGB', 3))", 3),
        ("IsValidPixel(CreatePixel('1-BIT', 'MONOCHROME', 1), '1-BIT', 1)", 1),
        ("IsValidPixel(CreatePixel('1-BIT', 'MONOCHROME', 1), '2-BIT', 1)", 0),
        ("IsValidPixel(CreatePixelNone(), 'UINT8', 3)", 1),
        ("IsValidPixel(NULL, 'UINT8', 3)", -1),
        ("IsPixelNone(CreatePixelNone())", 1),
        ("IsPixelNone(CreatePixel('UINT8', 'GRAYSCALE', 1))", 0),
        ("IsPixelNone(NULL)", -1),
        ("GetPixelValue(SetPixelValue(CreatePixel('INT8', 'DATAGRID', 1), 0, -128), 0)", -128.0),
        ("SetPixelValue(CreatePixel('INT8', 'DATAGRID', 1), 0, -129)", None),
        ("SetPixelValue(CreatePixel('UINT8', 'DATAGRID', 1), 0, 1.5)", None),
        ("GetPixelValue(SetPixelValue(CreatePixel('FLOAT', 'DATAGRID', 1), 0, 1.5), 0)", 1.5),
        ("GetPixelValue(CreatePixel('UINT8', 'GRAYSCALE', 1), 1)", None),
        ("GetPixelValue(CreatePixel('UINT8', 'GRAYSCALE', 1), -1)", None),
        ("SetPixelValue(NULL, 0, 1)", None),
        ("IsTransparentPixel(CreatePixel('UINT8', 'GRAYSCALE', 1))", 0),
        ("IsOpaquePixel(SetTransparentPixel(CreatePixel('UINT8', 'GRAYSCALE', 1)))", 0),
        ("IsTransparentPixel(NULL)", -1),
        ("PixelEquals(CreatePixel('UINT8', 'GRAYSCALE', 1), CreatePixel('UINT8', 'GRAYSCALE', 1))", 1),
        ("PixelEquals(CreatePixel('UINT8', 'GRAYSCALE', 1), SetTransparentPixel(CreatePixel('UINT8', 'GRAYSCALE', 1)))", 0),
        ("PixelEquals(CreatePixel('UINT8', 'GRAYSCALE', 1), CreatePixel('INT8', 'DATAGRID', 1))", -1),
        ("PixelEquals(CreatePixelNone(), CreatePixelNone())", -1),
        ("IsValidRasterPalette(NULL, 'UINT8')", -1),
        ("IsValidRasterPalette(array(struct(1 AS r, 2 AS g, 3 AS b)), 'INT16')", 0),
        ("GetPaletteColorEntry(array(struct(1 AS r, 2 AS g, 255 AS b)), 0)", "#0102ff"),
        ("GetPaletteColorEntry(array(struct(1 AS r, 2 AS g, 255 AS b)), 1)", None),
        ("SetPaletteColorEntry(array(struct(1 AS r, 2 AS g, 255 AS b)), 0, 'red')", None),
        ("PaletteEquals(array(struct(1 AS r, 2 AS g, 3 AS b)), NULL)", -1),
        ("has_codec_deflate()", 1),
        ("has_codec_webp()", 0),
        ("has_codec_jpeg()", 1),
        ("has_codec_lzma()", 1),
        ("cairo_version()", None),
        ("zlib_version() IS NOT NULL", True),
    ],
)
def test_contract(sql, expression, want):
    assert sql(expression) == want


def test_threads(spark):
    before = sqlnames.max_threads(spark)
    assert sqlnames.set_max_threads(spark, 256) == 64
    assert sqlnames.set_max_threads(spark, 0) == 1
    assert sqlnames.set_max_threads(spark, None) == -1
    spark.conf.set("spark.sql.shuffle.partitions", before)
