"""Pixel tables packed into runs, so that a pixel that is shuffled costs its value and not a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run never crosses a multiple of this many columns, less one.
TILE = 256


def pixel_runs(pixels: DataFrame, value: str) -> DataFrame:
    """``image_id, row, lo, run``: the values of pixels of one row in consecutive columns from ``lo``.

    Packed batch by batch where the pixels lie, without a shuffle or a sort of the table. A table in another order gives shorter
    runs, at worst one a pixel; repeated pixels lie in runs of their own. Pixels without a place are left out.
    """
    at = pixels.where("image_id IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")
    at = at.select("image_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).alias("v"))
    kinds = dict(pixels.dtypes)
    return at.mapInArrow(_packed, f"image_id {kinds['image_id']}, row long, lo long, run array<{kinds[value]}>")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        image, row, col = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        after = lambda: (image[1:] == image[:-1]) & (row[1:] == row[:-1]) & (col[1:] == col[:-1] + 1) & ((col[1:] + 1) % TILE != 0)
        follows = after()
        if 2 * follows.sum() < len(row):
            order = np.lexsort((col, row, image))
            batch = batch.take(pa.array(order))
            image, row, col = image[order], row[order], col[order]
            follows = after()
        start = np.flatnonzero(np.append(True, ~follows))
        first = batch.take(pa.array(start))
        runs = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.concat_arrays([batch.column(3)]))
        yield pa.RecordBatch.from_arrays([first.column(0), first.column(1), first.column(2), runs], names=["image_id", "row", "lo", "run"])
