"""Raw pixel buffers: width x height x bands samples, row by row, little or big endian."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import SAMPLES


def decode(buffers: DataFrame, width: int, height: int, bands: int, sample: str, big_endian: bool = False, content: str = "content") -> DataFrame:
    """(r, c, bands) of each buffer; one of the wrong size raises."""
    kind = np.dtype((">" if big_endian else "<") + SAMPLES[sample][3])
    size = width * height * bands * kind.itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buffer in batch.column(0).to_pylist():
                if len(buffer) != size:
                    raise ValueError(f"{len(buffer)} bytes where {size} are due")
                x = np.frombuffer(buffer, kind).astype(np.float64).reshape(height, width, bands)
                for r in range(height):  # a row of the raster at a time
                    flat = pa.array(x[r].reshape(-1))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(width + 1) * bands, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(width, r)), pa.array(np.arange(width)), lists], names=["r", "c", "bands"])

    return buffers.select(content).mapInArrow(run, "r long, c long, bands array<double>")


def encode(cells: DataFrame, sample: str, big_endian: bool = False, row: str = "out_y", col: str = "out_x", bands: str = "bands") -> DataFrame:
    """(row, content): each row of a dense window as bytes; in row order they are the buffer."""
    kind = np.dtype((">" if big_endian else "<") + SAMPLES[sample][3])
    ordered = cells.groupBy(row).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(col, bands))), lambda s: s[bands])).alias("flat"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [np.asarray(x, np.float64).astype(kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=[row, "content"])

    return ordered.select(F.col(row).cast("long").alias(row), "flat").mapInArrow(run, f"{row} long, content binary")
