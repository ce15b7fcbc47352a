"""TIFF kinds: files of the JVM's own writer, and files put together here."""

import lzma
import struct
import zlib

import numpy as np
import pytest

from gridloom.sources import images


def by_the_jvm(spark, x, compression, bits=8):
    """A TIFF of (h, w, bands) bytes, or of one band of 1 bit."""
    jvm = spark.sparkContext._jvm
    io, java = jvm.javax.imageio, jvm.java.io
    if bits == 1:
        picture = jvm.java.awt.image.BufferedImage(x.shape[1], x.shape[0], 12)
        raster = picture.getRaster()
        for r in range(x.shape[0]):
            for c in range(x.shape[1]):
                raster.setSample(c, r, 0, int(x[r, c, 0]))
    else:
        picture = io.ImageIO.read(java.ByteArrayInputStream(bytearray(images.encode_png(x[:, :, 0] if x.shape[2] == 1 else x))))
    out, writer = java.ByteArrayOutputStream(), io.ImageIO.getImageWritersByFormatName("tiff").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionType(compression)
    stream = io.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(picture, None, None), how)
    stream.close()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("compression", ["LZW", "PackBits", "ZLib", "Deflate"])
@pytest.mark.parametrize("bands", [1, 3])
def test_files_of_the_jvm(spark, compression, bands):
    rng = np.random.default_rng(bands)
    x = np.where(rng.random((150, 210, 1)) < 0.5, rng.integers(0, 256, (150, 210, bands)), 7).astype(np.uint8)
    x[40:90] = 200
    got, _ = images.decode_tiff(by_the_jvm(spark, x, compression))
    assert np.array_equal(got, x)


def test_one_bit_of_the_jvm(spark):
    x = np.random.default_rng(1).integers(0, 2, (9, 21, 1)).astype(np.uint8)
    for compression in ("LZW", "PackBits"):
        got, _ = images.decode_tiff(by_the_jvm(spark, x, compression, 1))
        assert np.array_equal(got, x)


def put_together(blocks, tags, e="<"):
    """A TIFF of blocks (strips, or tiles where tag 322 is given) and short or long tags."""
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    first = 324 if 322 in tags else 273
    tags = tags | {first: offsets, 325 if first == 324 else 279: [len(b) for b in blocks]}
    directory, extra, start = b"", b"", at + 6 + 12 * len(tags)
    for tag in sorted(tags):
        packed = struct.pack(f"{e}{len(tags[tag])}I", *tags[tag])
        field = packed if len(packed) == 4 else struct.pack(e + "I", start + len(extra))
        extra += b"" if len(packed) == 4 else packed
        directory += struct.pack(e + "HHI", tag, 4, len(tags[tag])) + field
    return struct.pack(e + "2sHI", b"II" if e == "<" else b"MM", 42, at) + b"".join(blocks) + struct.pack(e + "H", len(tags)) + directory + struct.pack(e + "I", 0) + extra


@pytest.mark.parametrize("e", ["<", ">"])
@pytest.mark.parametrize("size", [1, 2, 4])
def test_differences_along_rows(e, size):
    kind = np.dtype(f"{e}u{size}")
    x = np.random.default_rng(size).integers(0, 256**size, (10, 6, 3)).astype(kind)
    steps = np.diff(x.astype(kind.newbyteorder("=")), axis=1, prepend=np.zeros((10, 1, 3), kind.newbyteorder("="))).astype(kind)
    blocks = [zlib.compress(steps[i : i + 4].tobytes()) for i in range(0, 10, 4)]
    got, _ = images.decode_tiff(put_together(blocks, {256: [6], 257: [10], 258: [8 * size] * 3, 259: [8], 277: [3], 278: [4], 317: [2]}, e))
    assert np.array_equal(got, x)


def test_floats_by_bytes():
    x = np.random.default_rng(0).normal(size=(5, 7, 2)).astype("<f4")
    rows = []
    for row in x.reshape(5, 14):
        planes = row.astype(">f4").view(np.uint8).reshape(14, 4).T.reshape(-1, 2)
        rows.append(np.diff(planes, axis=0, prepend=np.zeros((1, 2), np.uint8)).astype(np.uint8).tobytes())
    got, _ = images.decode_tiff(put_together([lzma.compress(b"".join(rows))], {256: [7], 257: [5], 258: [32, 32], 259: [34925], 277: [2], 278: [5], 317: [3], 339: [3, 3]}))
    assert np.array_equal(got, x)


def test_bands_apart_in_tiles_and_strips():
    x = np.random.default_rng(4).integers(0, 255, (20, 35, 3)).astype(np.uint8)
    padded = np.pad(x, ((0, 12), (0, 13), (0, 0)))
    tiles = [padded[y : y + 16, c : c + 16, b].tobytes() for b in range(3) for y in (0, 16) for c in (0, 16, 32)]
    common = {256: [35], 257: [20], 258: [8] * 3, 277: [3], 284: [2]}
    got, _ = images.decode_tiff(put_together(tiles, common | {322: [16], 323: [16]}))
    assert np.array_equal(got, x)
    strips = [x[y : y + 8, :, b].tobytes() for b in range(3) for y in (0, 8, 16)]
    got, _ = images.decode_tiff(put_together(strips, common | {278: [8]}))
    assert np.array_equal(got, x)


@pytest.mark.parametrize("sample", ["1-BIT", "2-BIT", "4-BIT"])
def test_packed_samples_come_back(sample):
    x = np.random.default_rng(2).integers(0, 2 ** int(sample[0]), (70, 13, 1)).astype(np.uint8)
    for compress in (False, True):
        content = images.encode_tiff(x, sample, compress=compress)
        got, tags = images.decode_tiff(content)
        assert np.array_equal(got, x) and tags[258] == [int(sample[0])]


def test_what_is_not_read_raises():
    for tags in ({259: [4]}, {258: [12]}, {266: [2]}, {317: [3]}, {258: [4], 317: [2]}):
        with pytest.raises(ValueError):
            images.decode_tiff(put_together([bytes(64)], {256: [4], 257: [4], 258: [8], 278: [4]} | tags))
    with pytest.raises(ValueError):
        images.decode_tiff(put_together([bytes(3)], {256: [4], 257: [4], 258: [8], 278: [4]}))
    with pytest.raises(ValueError):
        images.unpack_lzw(b"\xff\xff\xff")
