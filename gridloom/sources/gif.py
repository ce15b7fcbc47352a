"""GIF of one image: palette indices, by the variable-width codes of the format."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

#: First rows and steps of an interlaced image (fixed values of the format).
_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def _squeezed(indices: bytes, bits: int) -> bytes:
    """Codes from bits + 1 to 12 wide, lowest bit first."""
    clear = 1 << bits
    roots = {bytes([i]): i for i in range(clear)}
    table, width, held, used, out = dict(roots), bits + 1, clear, bits + 1, bytearray()
    following = clear + 2
    run = b""
    for i in range(len(indices)):
        longer = run + indices[i : i + 1]
        if longer in table:
            run = longer
            continue
        held |= table[run] << used
        used += width
        if following < 4096:
            table[longer] = following
            width += following == 1 << width
            following += 1
        else:
            held |= clear << used
            used += width
            table, width, following = dict(roots), bits + 1, clear + 2
        run = indices[i : i + 1]
        while used >= 8:
            out.append(held & 255)
            held >>= 8
            used -= 8
    if run:
        held |= table[run] << used
        used += width
        width += following == 1 << width and width < 12
    held |= (clear + 1) << used
    used += width
    while used > 0:
        out.append(held & 255)
        held >>= 8
        used -= 8
    return bytes(out)


def _spread(data: bytes, bits: int, size: int) -> bytes:
    clear = 1 << bits
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last, held, used, out = list(roots), bits + 1, b"", 0, 0, bytearray()
    for byte in data:
        held |= byte << used
        used += 8
        while used >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            used -= width
            if code == clear:
                table, width, last = list(roots), bits + 1, b""
                continue
            if code == clear + 1:
                return bytes(out[:size])
            if code > len(table) or (code == len(table) and not last):
                raise ValueError("a code beyond the table")
            entry = table[code] if code < len(table) else last + last[:1]
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                width += len(table) == 1 << width and width < 12
            out += entry
            last = entry
    return bytes(out[:size])


def encode(x: np.ndarray, palette: Sequence[tuple[int, int, int]] | None = None) -> bytes:
    """Indices (h, w) of 0 to 255; without a palette they are grays."""
    h, w = x.shape
    colours = [*(palette if palette is not None else [(v, v, v) for v in range(256)])]
    most = int(x.max()) if x.size else 0
    if len(colours) > 256 or most >= len(colours):
        raise ValueError("an index without a colour")
    depth = max(1, (len(colours) - 1).bit_length())
    table = bytes(v for c in colours for v in c).ljust(3 << depth, b"\0")
    bits = max(2, depth)
    data = _squeezed(np.ascontiguousarray(x, np.uint8).tobytes(), bits)
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | (depth - 1) << 4 | (depth - 1), 0, 0) + table + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([bits]) + blocks + b"\0;"


def decode(b: bytes) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Indices (h, w) and palette of a GIF's first image; ValueError for what is none."""
    if b[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")

    def colours(flags: int, at: int) -> tuple[list[tuple[int, int, int]], int]:
        n = 2 << (flags & 7) if flags & 0x80 else 0
        return [tuple(b[at + 3 * k : at + 3 * k + 3]) for k in range(n)], at + 3 * n

    palette, at = colours(b[10], 13)
    while at < len(b) and b[at] != 0x3B:
        image = b[at] == 0x2C
        if image:
            w, h, flags = struct.unpack("<HHB", b[at + 5 : at + 10])
            own, at = colours(flags, at + 10)
            bits, at = b[at], at + 1
        else:  # an extension: a label and blocks
            at += 2
        data = bytearray()
        while b[at]:
            data += b[at + 1 : at + 1 + b[at]]
            at += 1 + b[at]
        at += 1
        if image:
            x = np.frombuffer(_spread(bytes(data), bits, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in _PASSES for y in range(first, h, step)]
                x = x[np.argsort(order)]
            return x, own or palette
    raise ValueError("no image in the GIF")
