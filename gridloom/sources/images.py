"""TIFF, PNG and world files with the standard library: a driver-side encoder per image, rows made by Spark.

An image is limited to MAX_SIDE squared by the map guard, so its rows fit the writer.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..types import SAMPLES

MAX_SIDE = 8192
_TYPES = {1: "u1", 2: "u1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8"}
_FORMATS = {"u": 1, "i": 2, "f": 3}


def world_file(xres: float, yres: float, minx: float, maxy: float) -> str:
    """Six lines: x resolution, two zeros, minus y resolution, and the centre of the upper left pixel."""
    return "".join(f"        {v:1.16f}\n" for v in (xres, 0.0, 0.0, -yres, minx + xres / 2, maxy - yres / 2))


def parse_world_file(text: str) -> tuple[float, float, float, float]:
    """x resolution, y resolution, least x, largest y."""
    v = [float(x) for x in text.split()[:6]]
    return v[0], -v[3], v[4] - v[0] / 2, v[5] + v[3] / -2


def encode_png(x: np.ndarray) -> bytes:
    """Bytes (h, w) gray, (h, w, 3) RGB or (h, w, 4) RGBA."""
    kind = {2: 0}.get(x.ndim, {3: 2, 4: 6}.get(x.shape[-1]))
    h, w = x.shape[:2]
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(x, np.uint8))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


PNG = b"\x89PNG\r\n\x1a\n"


#: First row and column and steps of the passes of an interlaced PNG (fixed values of the format).
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unfiltered(data: bytes, w: int, h: int, bands: int, bits: int) -> tuple[np.ndarray, int]:
    """(h, w, bands) of filtered rows, and the bytes that these took."""
    wide = (w * bands * bits + 7) // 8
    back = max(1, bands * bits // 8)
    lines = np.frombuffer(data, np.uint8, h * (wide + 1)).reshape(h, wide + 1)
    out = np.zeros((h, wide), np.uint8)
    above = np.zeros(wide, np.uint8)
    for y in range(h):
        how, line = lines[y, 0], lines[y, 1:].copy()
        if how == 1:  # to the left: sums modulo 256 per byte of a pixel
            for k in range(back):
                line[k::back] = np.cumsum(line[k::back], dtype=np.uint8)
        elif how == 2:
            line += above
        elif how in (3, 4):
            row, up = line.tolist(), above.tolist()
            for i in range(wide):
                left, upper_left = (row[i - back], up[i - back]) if i >= back else (0, 0)
                if how == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - upper_left
                    guess = min((left, up[i], upper_left), key=lambda v, p=p: abs(p - v))
                row[i] = (row[i] + guess) & 255
            line = np.array(row, np.uint8)
        out[y] = above = line
    if bits == 16:
        cells = out.view(">u2").astype(np.uint16)
    elif bits < 8:
        per = np.unpackbits(out, axis=1).reshape(h, -1, bits)
        cells = (per * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :w]
    else:
        cells = out
    return cells.reshape(h, w, bands), h * (wide + 1)


def decode_png(b: bytes) -> np.ndarray:
    """(h, w, bands) of a PNG, interlaced or not: gray, RGB, either with alpha, or palette indices."""
    if b[:8] != PNG:
        raise ValueError("no PNG")
    at, data, head = 8, b"", None
    while at + 8 <= len(b):
        size, tag = struct.unpack(">I4s", b[at : at + 8])
        part = b[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif tag == b"IDAT":
            data += part
        at += 12 + size
    if head is None or head[6] > 1:
        raise ValueError("this kind of PNG isn't read")
    w, h, bits, kind = head[:4]
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    data = zlib.decompress(data)
    if not head[6]:
        return _unfiltered(data, w, h, bands, bits)[0]
    out, at = np.zeros((h, w, bands), np.uint16 if bits == 16 else np.uint8), 0
    for y, x, down, across in _PASSES:
        rows, columns = max(0, -(-(h - y) // down)), max(0, -(-(w - x) // across))
        if rows and columns:
            out[y::down, x::across], taken = _unfiltered(data[at:], columns, rows, bands, bits)
            at += taken
    return out


def encode_tiff(x: np.ndarray, sample: str, geo: tuple[float, float, float, float] | None = None, srid: int | None = None, compress: bool = False) -> bytes:
    """(h, w, bands) in strips of 64 rows, samples of 1, 2 and 4 bits packed; geo: x and y resolution, least x, largest y."""
    kind = np.dtype("<" + SAMPLES[sample][3])
    h, w, bands = x.shape
    data = np.ascontiguousarray(x.astype(kind))
    bits = kind.itemsize * 8
    if sample in ("1-BIT", "2-BIT", "4-BIT"):  # a row fills whole bytes
        bits = int(sample[0])
        data = np.packbits(np.unpackbits(data.reshape(h, w * bands, 1), axis=2)[:, :, 8 - bits :].reshape(h, -1), axis=1)
    strips = [data[i : i + 64].tobytes() for i in range(0, h, 64)]
    if compress:
        strips = [zlib.compress(s) for s in strips]
    entries: list[tuple[int, int, list]] = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * bands), (259, 3, [8 if compress else 1]), (262, 3, [2 if bands == 3 and sample == "UINT8" else 1]),
        (273, 4, []), (277, 3, [bands]), (278, 4, [64]), (279, 4, [len(s) for s in strips]), (284, 3, [1]), (339, 3, [_FORMATS[kind.kind]] * bands),
    ]
    if geo:
        entries += [(33550, 12, [geo[0], geo[1], 0.0]), (33922, 12, [0.0, 0.0, 0.0, geo[2], geo[3], 0.0])]
        if srid and srid > 0:
            model = 2 if srid == 4326 else 1
            entries.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 2048 if model == 2 else 3072, 0, 1, srid]))
    place, offsets = 8, []
    for s in strips:
        offsets.append(place)
        place += len(s)
    entries[5] = (273, 4, offsets)
    entries.sort()
    directory, extra, start = b"", b"", place + 2 + 12 * len(entries) + 4
    for tag, t, values in entries:
        packed = np.array(values, "<" + _TYPES[t]).tobytes()
        if len(packed) > 4:
            field = struct.pack("<I", start + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            field = packed.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, t, len(values)) + field
    return struct.pack("<2sHI", b"II", 42, place) + b"".join(strips) + struct.pack("<H", len(entries)) + directory + struct.pack("<I", 0) + extra


def unpack_lzw(b: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first, a code wider one entry before the table is full."""
    roots = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out = list(roots), 9, b"", bytearray()
    held = bits = 0
    for byte in b:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(roots), 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("a code beyond the table")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        out += entry
        last = entry
    return bytes(out)


def unpack_bits(b: bytes) -> bytes:
    """Runs of bytes: a length of 0 to 127 and one more bytes as they are, or of 129 to 255 and one byte 257 less length times."""
    out, at = bytearray(), 0
    while at < len(b):
        n = b[at]
        if n < 128:
            out += b[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += b[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


#: Decoders by the number of a TIFF's compression (fixed values of the format).
_UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits, 34925: lzma.decompress}


def _block(data: bytes, h: int, w: int, bands: int, kind: np.dtype, bits: int, predictor: int) -> np.ndarray:
    """(h, w, bands) of a strip or tile once unpacked: samples under a byte fill bytes row by row, predicted ones are sums along the row."""
    wide = (w * bands * bits + 7) // 8
    if len(data) < h * wide:
        raise ValueError("a strip or tile is short")
    rows = np.frombuffer(data, np.uint8, h * wide).reshape(h, wide)
    if bits < 8:
        per = np.unpackbits(rows, axis=1)[:, : w * bands * bits].reshape(h, w * bands, bits)
        return (per << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8).reshape(h, w, bands)
    if predictor == 3:  # bytes of floats, the highest of all samples first
        sums = np.cumsum(rows.reshape(h, -1, bands), axis=1, dtype=np.uint8).reshape(h, kind.itemsize, w * bands)
        return np.ascontiguousarray(sums.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w, bands)
    x = rows.view(kind).reshape(h, w, bands)
    return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else x


def decode_tiff(b: bytes) -> tuple[np.ndarray, dict]:
    """(h, w, bands) and tags, of strips or tiles, bands together or apart, samples of 1, 2, 4 bits or of whole bytes; ValueError for other kinds and for fax and JPEG data."""
    e = {b"II": "<", b"MM": ">"}.get(b[:2])
    if e is None or struct.unpack(e + "H", b[2:4])[0] != 42:
        raise ValueError("no TIFF")
    (at,) = struct.unpack(e + "I", b[4:8])
    (n,) = struct.unpack(e + "H", b[at : at + 2])
    tags: dict[int, list] = {}
    for i in range(n):
        tag, t, count = struct.unpack(e + "HHI", b[at + 2 + 12 * i : at + 10 + 12 * i])
        if t not in _TYPES and t != 7:
            continue
        kind = np.dtype(e + _TYPES.get(t, "u1"))
        field = b[at + 10 + 12 * i : at + 14 + 12 * i]
        start = at + 10 + 12 * i if kind.itemsize * count <= 4 else struct.unpack(e + "I", field)[0]
        tags[tag] = np.frombuffer(b, kind, count, start).tolist()
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    depths, letter = set(tags.get(258, [1])), {1: "u", 2: "i", 3: "f", 4: "u"}[tags.get(339, [1])[0]]
    bits, packing, apart, predictor = min(depths), tags.get(259, [1])[0], tags.get(284, [1])[0] == 2, tags.get(317, [1])[0]
    known = len(depths) == 1 and (bits in (8, 16, 32, 64) or (bits in (1, 2, 4) and letter == "u"))
    fitting = predictor == 1 or (predictor == 2 and bits >= 8 and letter != "f") or (predictor == 3 and letter == "f")
    if not known or not fitting or packing not in _UNPACK or tags.get(266, [1])[0] != 1:
        raise ValueError("this kind of TIFF isn't read")
    kind = np.dtype(f"{e}{letter}{max(1, bits // 8)}")
    out = np.zeros((h, w, bands), kind)
    together = 1 if apart else bands
    if 324 in tags:
        tw, th = tags[322][0], tags[323][0]
        across, down = -(-w // tw), -(-h // th)
        for i, (o, size) in enumerate(zip(tags[324], tags[325], strict=True)):
            band, place = divmod(i, across * down)
            y, x = place // across * th, place % across * tw
            part = _block(_UNPACK[packing](b[o : o + size]), th, tw, together, kind, bits, predictor)
            out[y : y + th, x : x + tw, band : band + together] = part[: h - y, : w - x]
    else:
        rows = min(h, tags.get(278, [h])[0])
        down = -(-h // rows)
        for i, (o, size) in enumerate(zip(tags[273], tags[279], strict=True)):
            band, place = divmod(i, down)
            part = _block(_UNPACK[packing](b[o : o + size]), min(rows, h - place * rows), w, together, kind, bits, predictor)
            out[place * rows : place * rows + rows, :, band : band + together] = part
    return out, tags


def georeference(tags: dict) -> tuple[float, float, float, float] | None:
    """x and y resolution, least x, largest y of a TIFF's tags, if it has them."""
    if 33550 not in tags or 33922 not in tags:
        return None
    (sx, sy, *_), tie = tags[33550], tags[33922]
    return sx, sy, tie[3] - tie[0] * sx, tie[4] + tie[1] * sy


def read_tiff(files: DataFrame) -> DataFrame:
    """(path, r, c, bands) of binaryFile rows (path, content): one file a task, a row of cells at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, _ = decode_tiff(content)
                h, w, bands = x.shape
                for r in range(h):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(w + 1) * bands, pa.int32()), pa.array(x[r].reshape(-1).astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * w), pa.array(np.full(w, r)), pa.array(np.arange(w)), lists], names=["path", "r", "c", "bands"])

    return files.select("path", "content").mapInArrow(run, "path string, r long, c long, bands array<double>")


def gathered(cells: DataFrame, width: int, height: int, bands: int) -> np.ndarray:
    """A dense window (out_y, out_x, bands) as an array on the driver: for images, of MAX_SIDE squared and of four bands of that at most."""
    if width * height > MAX_SIDE * MAX_SIDE or width * height * bands > 4 * MAX_SIDE * MAX_SIDE:
        raise ValueError(f"an image has {MAX_SIDE} x {MAX_SIDE} pixels at most, of four bands")
    out = np.zeros((height, width, bands))
    for batch in cells.select("out_y", "out_x", "bands").toArrow().to_batches():
        out[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).flatten().to_numpy().reshape(-1, bands)
    return out
