"""An image on a page of a PDF: objects, their places and a trailer, with the standard library."""

from __future__ import annotations

import zlib

import numpy as np

#: Sides of a page and its free margin in inches, and the densities tried from the lowest (fixed values).
SHORT, LONG, MARGIN, DENSITIES = 8.3, 11.7, 1.0, (150, 300, 600)


def page(width: int, height: int) -> tuple[float, float, int]:
    """Width and height of the page and dots an inch: the lowest density at which the image fits, upright before lying; the last where none fits."""
    tried = [(w, h, dpi) for dpi in DENSITIES for w, h in ((SHORT, LONG), (LONG, SHORT))]
    return next((p for p in tried if width <= (p[0] - 2 * MARGIN) * p[2] + 1e-6 and height <= (p[1] - 2 * MARGIN) * p[2] + 1e-6), tried[-1])


def encode(x: np.ndarray) -> bytes:
    """One page of RGBA bytes (h, w, 4), at the upper left of the margins, cut at them; alpha is a soft mask where any pixel has it."""
    h, w = x.shape[:2]
    wide, high, dpi = page(w, h)
    scale, margin = 72 / dpi, 72 * MARGIN
    masked = bool((x[:, :, 3] < 255).any())
    shows = (
        f"{margin:g} {margin:g} {72 * wide - 2 * margin:g} {72 * high - 2 * margin:g} re W n\n"
        f"{w * scale:g} 0 0 {h * scale:g} {margin:g} {72 * high - margin - h * scale:g} cm /Map Do\n"
    ).encode()

    def stream(entries: str, data: bytes) -> bytes:
        packed = zlib.compress(data)
        return f"<< {entries} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream"

    def picture(space: str, data: np.ndarray, more: str = "") -> bytes:
        return stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{space} /BitsPerComponent 8{more}", np.ascontiguousarray(data, np.uint8).tobytes())

    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {72 * wide:g} {72 * high:g}] /Contents 4 0 R /Resources << /XObject << /Map 5 0 R >> >> >>".encode(),
        stream("", shows),
        picture("DeviceRGB", x[:, :, :3], " /SMask 6 0 R" if masked else ""),
    ]
    if masked:
        objects.append(picture("DeviceGray", x[:, :, 3]))
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
