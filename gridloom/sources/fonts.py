"""TrueType and OpenType fonts: family, style and weight from their own tables."""

from __future__ import annotations

import struct


def names(content: bytes | None) -> dict | None:
    """family, facename, bold, italic of a font file's bytes; None for what is no font."""
    try:
        if content[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
            return None
        (n,) = struct.unpack(">H", content[4:6])
        tables = {content[12 + 16 * i : 16 + 16 * i]: struct.unpack(">II", content[20 + 16 * i : 28 + 16 * i]) for i in range(n)}
        at, _ = tables[b"name"]
        _, count, strings = struct.unpack(">HHH", content[at : at + 6])
        found: dict[int, str] = {}
        for i in range(count):
            platform, encoding, _, kind, size, place = struct.unpack(">HHHHHH", content[at + 6 + 12 * i : at + 18 + 12 * i])
            text = content[at + strings + place : at + strings + place + size]
            if kind in (1, 2, 4) and (kind not in found or platform == 3):
                found[kind] = text.decode("utf-16-be" if platform in (0, 3) else "mac-roman", "replace")
        head, _ = tables[b"head"]
        (style,) = struct.unpack(">H", content[head + 44 : head + 46])
        family = found[1]
        return {"family": family, "facename": f"{family}-{found.get(2, 'Regular')}", "bold": style & 1, "italic": style >> 1 & 1}
    except (KeyError, struct.error, TypeError):
        return None
