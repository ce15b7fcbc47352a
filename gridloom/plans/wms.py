"""Web map service: answers to requests about a catalog, and a client that loads maps of another service as sections.

answer() is a function of the query string, so any HTTP front end can carry it; serve() is the least one.  The
client's tiles are requested by the executors.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from urllib.parse import parse_qsl, urlencode
from urllib.request import urlopen
from xml.sax.saxutils import escape

import numpy as np

from ..operators import statistics
from ..sources import files
from . import load, maps
from .coverage import Catalog

VERSIONS = ("1.0.0", "1.1.0", "1.1.1", "1.3.0")


def capabilities(catalog: Catalog) -> str:
    """The layers that are to be queried, with their bounds and styles."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<WMS_Capabilities version="1.3.0"><Service><Name>WMS</Name><Title>maps</Title></Service><Capability><Request><GetMap><Format>image/png</Format><Format>image/jpeg</Format></GetMap></Request><Layer>']
    for name in catalog.names():
        c = catalog.get(name)
        box = statistics.extent(catalog.sections(name)).first()
        if box.minx is None:
            continue
        bounds = f'minx="{box.minx}" miny="{box.miny}" maxx="{box.maxx}" maxy="{box.maxy}"'
        styles = "".join(f"<Style><Name>{escape(s)}</Name></Style>" for s in ["default", *c.styles])
        out.append(f'<Layer queryable="{int(c.queryable)}"><Name>{escape(c.name)}</Name><Title>{escape(c.title or c.name)}</Title><CRS>EPSG:{c.srid}</CRS><BoundingBox CRS="EPSG:{c.srid}" {bounds}/>{styles}</Layer>')
    return "\n".join([*out, "</Layer></Capability></WMS_Capabilities>"])


def layers(document: str) -> list[dict]:
    """name, title, srs, box and styles of the named layers of a capabilities document."""
    tag = lambda e: e.tag.rpartition("}")[2]
    text = lambda e, n: next((x.text or "" for x in e if tag(x) == n), None)
    out = []
    for e in ET.fromstring(document).iter():
        if tag(e) != "Layer" or text(e, "Name") is None:
            continue
        box = next((tuple(float(x.get(k)) for k in ("minx", "miny", "maxx", "maxy")) for x in e if tag(x) == "BoundingBox"), None)
        out.append({"name": text(e, "Name"), "title": text(e, "Title"), "srs": text(e, "CRS") or text(e, "SRS"), "box": box, "styles": [text(x, "Name") for x in e if tag(x) == "Style"]})
    return out


def _failed(why: str) -> tuple[int, str, bytes]:
    return 400, "text/xml", f"<ServiceExceptionReport><ServiceException>{escape(why)}</ServiceException></ServiceExceptionReport>".encode()


def answer(catalog: Catalog, query: str) -> tuple[int, str, bytes]:
    """Status, type and body for a query string: GetCapabilities, GetMap of one layer or several over each other, GetFeatureInfo."""
    q = {k.lower(): v for k, v in parse_qsl(query, keep_blank_values=True)}
    request = q.get("request", "").lower()
    if request == "getcapabilities":
        return 200, "text/xml", capabilities(catalog).encode()
    if request not in ("getmap", "getfeatureinfo"):
        return _failed("no such request")
    if q.get("version", "1.3.0") not in VERSIONS:
        return _failed("no such version")
    try:
        box, width, height = [float(x) for x in q["bbox"].split(",")], int(q["width"]), int(q["height"])
        names = q["layers"].split(",")
    except (KeyError, ValueError):
        return _failed("LAYERS, BBOX, WIDTH and HEIGHT are due")
    if len(box) != 4 or box[2] <= box[0] or box[3] <= box[1] or width < 1 or height < 1:
        return _failed("no such box")
    if request == "getfeatureinfo":
        try:
            i, j = int(q.get("i", q.get("x", ""))), int(q.get("j", q.get("y", "")))
        except ValueError:
            return _failed("I and J are due")
        if catalog.get(names[0]) is None:
            return _failed("no such layer")
        point = catalog.spark.createDataFrame([(box[0] + (i + 0.5) * (box[2] - box[0]) / width, box[3] - (j + 0.5) * (box[3] - box[1]) / height)], "x double, y double")
        return 200, "text/plain", " ".join(map(str, catalog.pixel_at(names[0], point).first().bands)).encode()
    styles = [s or None for s in q.get("styles", "").split(",")]
    styles += [None] * (len(names) - len(styles))
    ground = "#" + q.get("bgcolor", "0xffffff")[2:]
    clear = q.get("transparent", "false").lower() == "true"
    drawn = maps.map_group(catalog, list(zip(names, styles, strict=False)), box, width, height, ground, clear)
    content = maps.encoded(drawn, width, height, q.get("format", "image/png"))
    return _failed("no such layer, style or format") if content is None else (200, q.get("format", "image/png"), content)


def serve(catalog: Catalog, port: int = 8080):
    """An HTTP server of answer(); its serve_forever() runs it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = answer(catalog, self.path.partition("?")[2])
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def fetched(url: str) -> bytes:
    with urlopen(url, timeout=60) as found:
        return found.read()


def map_url(url: str, version: str, layer: str, style: str, kind: str, srid: int, box: Sequence[float], width: int, height: int, swap: bool = False, opaque: bool = True) -> str:
    """swap: y before x, as version 1.3.0 has it for some reference systems."""
    at = [box[1], box[0], box[3], box[2]] if swap else list(box)
    system = "CRS" if version == "1.3.0" else "SRS"
    query = {"SERVICE": "WMS", "REQUEST": "GetMap", "VERSION": version, "LAYERS": layer, "STYLES": style, system: f"EPSG:{srid}", "BBOX": ",".join(repr(float(v)) for v in at), "WIDTH": width, "HEIGHT": height, "FORMAT": kind, "TRANSPARENT": str(not opaque).upper()}
    return url + ("&" if "?" in url else "?") + urlencode(query)


def load_from_wms(
    catalog: Catalog, name: str, section: str, url: str, box: Sequence[float], version: str, layer: str, style: str, kind: str, xres: float, yres: float | None = None,
    opaque: bool = True, swap: bool = False, fetch: Callable[[str], bytes] = fetched,
) -> int:
    """A section of maps of another service, a request a tile; PNG alone.  fetch(url) gives an answer's body."""
    c = catalog.get(name)
    yres = yres or xres
    if c is None or version not in VERSIONS or box[2] <= box[0] or box[3] <= box[1] or xres <= 0:
        return -1
    if kind != "image/png" or c.bands not in (1, 3) or c.sample != "UINT8" or not catalog.fits(c, xres, yres):
        return 0
    bands, srid, minx, maxy = c.bands, c.srid, box[0], box[3]

    def tile(r: int, q: int, w: int, h: int) -> np.ndarray:
        part = (minx + q * xres, maxy - (r + h) * yres, minx + (q + w) * xres, maxy - r * yres)
        _, x, _ = files.decode(fetch(map_url(url, version, layer, style, kind, srid, part, w, h, swap, opaque)))
        x = x[:, :, :3] if x.shape[2] == 4 else x[:, :, :1] if x.shape[2] == 2 else x
        return np.repeat(x, 3, axis=2) if x.shape[2] < bands else x[:, :, :bands]

    return load.load_tiles(catalog, name, section, round((box[2] - box[0]) / xres), round((box[3] - box[1]) / yres), minx, maxy, tile)
