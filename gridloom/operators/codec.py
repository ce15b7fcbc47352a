"""Encoded tiles: the cells of each tile as one compressed buffer, and back.

NONE, DEFLATE, LZMA and their _NO forms without differences of neighbours, PNG for bytes of one or three bands and GIF for bytes of one.
A tile's cells meet in one task, a size that the tile's sides bound; payloads carry a one-byte mark of the codec.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources import gif, images
from ..types import SAMPLES

CODECS = ("NONE", "DEFLATE", "DEFLATE_NO", "LZMA", "LZMA_NO", "PNG", "GIF")
#: Numbers of bands of bytes that a codec of images takes.
_BANDS = {"PNG": (1, 3), "GIF": (1,)}


def packed(x: np.ndarray, codec: str) -> bytes:
    """A tile (h, w, bands) of its sample type as bytes."""
    if codec == "PNG":
        return images.encode_png(x[:, :, 0] if x.shape[2] == 1 else x)
    if codec == "GIF":
        return gif.encode(x[:, :, 0])
    flat = x.reshape(-1, x.shape[2])
    if codec in ("DEFLATE", "LZMA"):  # differences modulo the type's size, bit by bit for floats
        whole = flat.view(f"u{x.dtype.itemsize}")
        flat = np.concatenate([whole[:1], whole[1:] - whole[:-1]])
    raw = np.ascontiguousarray(flat).tobytes()
    return raw if codec == "NONE" else zlib.compress(raw) if codec.startswith("DEFLATE") else lzma.compress(raw)


def unpacked(content: bytes, codec: str, h: int, w: int, bands: int, kind: np.dtype) -> np.ndarray:
    if codec == "PNG":
        return images.decode_png(content)
    if codec == "GIF":
        return gif.decode(content)[0].reshape(h, w, 1)
    raw = content if codec == "NONE" else zlib.decompress(content) if codec.startswith("DEFLATE") else lzma.decompress(content)
    if codec in ("DEFLATE", "LZMA"):
        whole = np.frombuffer(raw, f"u{kind.itemsize}").reshape(-1, bands)
        return np.cumsum(whole, axis=0, dtype=whole.dtype).view(kind).reshape(h, w, bands)
    return np.frombuffer(raw, kind).reshape(h, w, bands)


def encoded(px: DataFrame, sample: str, nodata: list[float], tile_w: int, tile_h: int, codec: str) -> DataFrame:
    """(section_id, pyramid_level, tile_id, tile_row, tile_col, payload) of pixels; cells that aren't there are NO-DATA."""
    if codec not in CODECS or (codec in _BANDS and (SAMPLES[sample][3] != "u1" or len(nodata) not in _BANDS[codec])):
        raise ValueError(f"no codec {codec} for {len(nodata)} bands of {sample}")
    kind, keys = np.dtype(SAMPLES[sample][3]), ["section_id", "pyramid_level", "tile_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tile = None, None

        def out():
            content = bytes([CODECS.index(codec)]) + packed(tile, codec)
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(last, types, strict=True)), pa.array([content], pa.binary())], names=[*names, "payload"])

        names, types = [*keys, "tile_row", "tile_col"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
            r, c = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            values = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1)
            start = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
            for a, b in zip(start, [*start[1:], len(ids)], strict=True):
                if last is None or tuple(ids[a].tolist()) != last:
                    if last is not None:
                        yield out()
                    last, tile = tuple(ids[a].tolist()), np.tile(np.array(nodata).astype(kind), (tile_h, tile_w, 1))
                tile[r[a:b] % tile_h, c[a:b] % tile_w] = values[a:b].astype(kind)
        if last is not None:
            yield out()

    dealt = px.select(*keys, "tile_row", "tile_col", "r", "c", "bands").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "section_id int, pyramid_level int, tile_id long, tile_row long, tile_col long, payload binary")


def decoded(tiles: DataFrame, sample: str, bands: int, tile_w: int, tile_h: int) -> DataFrame:
    """(section_id, pyramid_level, tile_id, r, c, bands) of encoded tiles, NO-DATA cells too; a tile row at a time."""
    kind = np.dtype(SAMPLES[sample][3])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for section, level, tile, row, col, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = unpacked(content[1:], CODECS[content[0]], tile_h, tile_w, bands, kind)
                for k in range(tile_h):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(tile_w + 1) * bands, pa.int32()), pa.array(x[k].reshape(-1).astype(np.float64)))
                    columns = [pa.array([section] * tile_w, pa.int32()), pa.array([level] * tile_w, pa.int32()), pa.array([tile] * tile_w, pa.int64()), pa.array(np.full(tile_w, row * tile_h + k)), pa.array(col * tile_w + np.arange(tile_w)), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["section_id", "pyramid_level", "tile_id", "r", "c", "bands"])

    return tiles.select("section_id", "pyramid_level", "tile_id", "tile_row", "tile_col", "payload").mapInArrow(run, "section_id int, pyramid_level int, tile_id long, r long, c long, bands array<double>")
