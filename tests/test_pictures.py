"""PNG kinds, PDF pages and polygons of several rings."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.plans import maps
from gridloom.operators import codec
from gridloom.sources import gif, images, pdf


def by_the_jvm(spark, x):
    """An interlaced PNG of (h, w, 3) bytes."""
    io, java = spark.sparkContext._jvm.javax.imageio, spark.sparkContext._jvm.java.io
    picture = io.ImageIO.read(java.ByteArrayInputStream(bytearray(images.encode_png(x))))
    out, writer = java.ByteArrayOutputStream(), io.ImageIO.getImageWritersByFormatName("png").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)  # with passes
    stream = io.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(picture, None, None), how)
    stream.close()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("h, w", [(1, 1), (3, 2), (8, 8), (37, 53)])
def test_interlaced_png(spark, h, w):
    x = np.random.default_rng(h).integers(0, 256, (h, w, 3)).astype(np.uint8)
    content = by_the_jvm(spark, x)
    assert content[28] == 1
    assert np.array_equal(images.decode_png(content), x)


@pytest.mark.parametrize("size, want", [((900, 900), (8.3, 11.7, 150)), ((1400, 700), (11.7, 8.3, 150)), ((1500, 1500), (8.3, 11.7, 300)), ((5000, 3000), (11.7, 8.3, 600)), ((8000, 8000), (11.7, 8.3, 600))])
def test_pages(size, want):
    assert pdf.page(*size) == want


@pytest.mark.parametrize("masked", [False, True])
def test_pdf(masked):
    x = np.random.default_rng(0).integers(0, 256, (30, 40, 4)).astype(np.uint8)
    if not masked:
        x[:, :, 3] = 255
    content = pdf.encode(x)
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", content).group(1))
    places = [int(p) for p in re.findall(rb"(\d{10}) 00000 n ", content[start:])]
    assert content[start : start + 4] == b"xref" and len(places) == (6 if masked else 5)
    for k, p in enumerate(places, 1):
        assert content[p:].startswith(f"{k} 0 obj\n".encode())
    found = [zlib.decompress(content[m.end() : m.end() + int(m.group(1))]) for m in re.finditer(rb"/Length (\d+) >>\nstream\n", content)]
    assert found[1] == x[:, :, :3].tobytes() and (b"/SMask" in content) == masked
    if masked:
        assert found[2] == x[:, :, 3].tobytes()


def ring(*corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


def test_a_hole_is_neither_filled_nor_lost_by_its_stroke(spark):
    rings = F.array(ring((8, 8), (56, 8), (56, 56), (8, 56)), ring((24, 24), (40, 24), (40, 40), (24, 40)))
    f = spark.range(1).select(F.col("id").alias("fid"), rings.alias("rings"))
    x = maps.array(maps.map_layer(f, "polygon", [maps.VectorRule("all", fill="#ff0000", stroke="#0000ff")], (0, 0, 64, 64), 64, 64), 64, 64)
    assert x[16, 16].tolist()[:3] == [255, 0, 0] and x[32, 32].tolist()[:3] == [255, 255, 255]
    assert x[24, 30].tolist()[:3] == [0, 0, 255] and x[8, 30].tolist()[:3] == [0, 0, 255]


def test_a_map_as_pdf(spark):
    cells = maps.window(spark, 64, 64).select("out_y", "out_x", *[F.lit(v).alias(n) for n, v in zip("rgba", (1, 2, 3, 255), strict=True)])
    assert maps.encoded(cells, 64, 64, "application/x-pdf").startswith(b"%PDF-1.4")
    assert maps.encoded(cells, 64, 64, "application/pdf") is None


@pytest.mark.parametrize("h, w, most", [(1, 1, 1), (9, 7, 2), (60, 70, 4), (200, 300, 256), (300, 300, 16)])
def test_gif_goes_around_and_by_the_jvm(spark, h, w, most):
    rng = np.random.default_rng(most)
    x = np.where(rng.random((h, w)) < 0.5, rng.integers(0, most, (h, w)), most - 1).astype(np.uint8)
    palette = [(k, 255 - k, k // 2) for k in range(most)]
    content = gif.encode(x, palette)
    back, colours = gif.decode(content)
    assert np.array_equal(back, x) and colours[:most] == palette
    io, java = spark.sparkContext._jvm.javax.imageio, spark.sparkContext._jvm.java.io
    picture = io.ImageIO.read(java.ByteArrayInputStream(bytearray(content)))
    out = java.ByteArrayOutputStream()
    assert io.ImageIO.write(picture, "gif", out)
    again, colours = gif.decode(bytes(out.toByteArray()))
    assert [colours[v] for v in again.reshape(-1)] == [palette[v] for v in x.reshape(-1)]


def test_gif_of_constant_and_random_bytes():
    for x in (np.zeros((256, 256), np.uint8), np.random.default_rng(7).integers(0, 256, (256, 256)).astype(np.uint8)):
        assert np.array_equal(gif.decode(gif.encode(x))[0], x)
    with pytest.raises(ValueError):
        gif.encode(np.full((2, 2), 9), [(0, 0, 0)])
    for bad in (b"GIF87b", b"GIF89a" + bytes(7) + b";"):
        with pytest.raises(ValueError):
            gif.decode(bad)


def test_gif_tiles(spark):
    px = spark.range(40).select(F.lit(1).alias("section_id"), F.lit(0).alias("pyramid_level"), F.lit(0).cast("long").alias("tile_id"), F.lit(0).cast("long").alias("tile_row"), F.lit(0).cast("long").alias("tile_col"), F.floor(F.col("id") / 8).alias("r"), (F.col("id") % 8).alias("c"), F.array(F.col("id").cast("double")).alias("bands"))
    tiles = codec.encoded(px, "UINT8", [9.0], 8, 6, "GIF")
    got = {(r.r, r.c): r.bands[0] for r in codec.decoded(tiles, "UINT8", 1, 8, 6).collect()}
    assert got == {(k // 8, k % 8): float(k if k < 40 else 9) for k in range(48)}
    with pytest.raises(ValueError):
        codec.encoded(px, "UINT16", [0.0], 8, 6, "GIF")
