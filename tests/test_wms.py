"""The map service's answers, and its client against answers."""

from urllib.parse import parse_qsl

import numpy as np
import pytest

from gridloom.operators import codec
from gridloom.plans import wms
from gridloom.plans.coverage import Catalog
from gridloom.sources import images


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    cat = Catalog(spark, str(tmp_path_factory.mktemp("wms")))
    assert cat.create("g", "UINT8", "GRAYSCALE", 1, tile_w=256, tile_h=256, srid=3003) == 1
    px = spark.range(64 * 64).selectExpr("id div 64 AS r", "id % 64 AS c", "array(double(id % 200)) AS bands")
    assert cat.load("g", "s", px, 64, 64, 0.0, 64.0) == 1
    return cat


def test_answers(catalog):
    status, kind, body = wms.answer(catalog, "SERVICE=WMS&REQUEST=GetCapabilities")
    assert (status, kind) == (200, "text/xml")
    assert wms.layers(body.decode()) == [{"name": "g", "title": "g", "srs": "EPSG:3003", "box": (0.0, 0.0, 64.0, 64.0), "styles": ["default"]}]
    ask = "REQUEST=GetMap&VERSION=1.3.0&LAYERS={}&STYLES=&BBOX=0,0,64,64&WIDTH=64&HEIGHT=64&FORMAT={}"
    status, kind, body = wms.answer(catalog, ask.format("g", "image/png"))
    want = (np.arange(4096) % 200).reshape(64, 64)
    assert status == 200 and np.array_equal(images.decode_png(body)[:, :, 0], want)
    assert wms.answer(catalog, ask.format("g", "image/jpeg"))[2][:2] == b"\xff\xd8"
    for bad in (ask.format("none", "image/png"), ask.format("g", "image/svg"), "REQUEST=Else", ask.format("g", "image/png").replace("0,0,64,64", "0,0,0,0"), "REQUEST=GetMap", ask.format("g", "image/png").replace("1.3.0", "9")):
        assert wms.answer(catalog, bad)[0] == 400
    assert wms.answer(catalog, "REQUEST=GetFeatureInfo&LAYERS=g&BBOX=0,0,64,64&WIDTH=64&HEIGHT=64&I=3&J=1")[2] == b"67.0"


def fake(url):
    """A service that paints a pixel by its place: x in red, row from the top in green."""
    from gridloom.sources import images as im

    q = dict(parse_qsl(url.partition("?")[2]))
    x0, _, _, y1 = map(float, q["BBOX"].split(","))
    w, h = int(q["WIDTH"]), int(q["HEIGHT"])
    x = np.zeros((h, w, 3), np.uint8)
    x[:, :, 0] = (x0 + np.arange(w)) % 256
    x[:, :, 1] = ((400 - y1) + np.arange(h)[:, None]) % 256
    return im.encode_png(x)


def test_client(catalog, spark):
    assert catalog.create("rgb", "UINT8", "RGB", 3, tile_w=256, tile_h=256, srid=3003) == 1
    load = lambda *a, **k: wms.load_from_wms(catalog, *a, fetch=fake, **k)
    assert load("none", "s", "http://x/?", (0, 0, 300, 400), "1.3.0", "l", "", "image/png", 1.0) == -1
    assert load("rgb", "s", "http://x/?", (0, 0, 300, 400), "1.3.0", "l", "", "image/jpeg", 1.0) == 0
    assert load("rgb", "s", "http://x/?", (0, 0, 300, 400), "1.3.0", "l", "", "image/png", 1.0) == 1
    got = images.gathered(catalog.raw("rgb", 300, 400, 0.0, 400.0, 1.0), 300, 400, 3)
    assert np.array_equal(got[:, :, 0], np.tile(np.arange(300) % 256, (400, 1))) and np.array_equal(got[:, :, 1], np.tile((np.arange(400) % 256)[:, None], (1, 300)))
    swapped = wms.map_url("http://x", "1.1.1", "l", "s", "image/png", 4326, (1, 2, 3, 4), 5, 6, True)
    assert "BBOX=2.0%2C1.0%2C4.0%2C3.0" in swapped and "SRS=EPSG%3A4326" in swapped


@pytest.mark.parametrize("kind", ["u1", "i2", "u4", "f4", "f8"])
def test_tile_codecs(kind):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(6, 5, 3)) * 1000).astype(kind) if kind != "u1" else rng.integers(0, 256, (6, 5, 3)).astype(kind)
    # PNG takes bytes alone; GIF takes one band of them alone (tests/test_pictures.py)
    for name in ("NONE", "DEFLATE", "DEFLATE_NO", "LZMA", "LZMA_NO", *(["PNG"] if kind == "u1" else [])):
        assert np.array_equal(codec.unpacked(codec.packed(x, name), name, 6, 5, 3, np.dtype(kind)), x)
