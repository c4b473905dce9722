"""Measures of decoded pictures: arrays of grey or RGB values in, numbers out, a batch of pictures at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST_SIDE = 1024


def triangle_weights(source: int, target: int) -> np.ndarray:
    """target x source weights of a resize with the triangle filter: linear interpolation, widened where the picture shrinks."""
    ratio = source / target
    support = max(ratio, 1.0)
    centre = (np.arange(target) + 0.5) * ratio
    w = np.maximum(0.0, 1 - np.abs((np.arange(source) + 0.5)[None, :] - centre[:, None]) / support)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pictures (n, height, width[, channels]) in another size, rounded to whole values."""
    rows = np.einsum("yh,nh...->ny...", triangle_weights(pixels.shape[1], height), pixels)
    exact = np.einsum("xw,nyw...->nyx...", triangle_weights(pixels.shape[2], width), rows)
    return np.floor(np.round(exact, 6) + 0.5)  # halves go up, whatever the order of the sums


def shrink(pixels: np.ndarray, longest: int = LONGEST_SIDE) -> np.ndarray:
    """Pictures (n, height, width[, channels]) with neither side above `longest`, the aspect kept."""
    h, w = pixels.shape[1:3]
    scale = longest / max(h, w)
    return pixels if scale >= 1 else resize(pixels, max(1, round(h * scale)), max(1, round(w * scale)))


def laplacian_variance(grey: np.ndarray) -> np.ndarray:
    """Population variance of the four-neighbour Laplacian of each picture; 0 below three pixels a side."""
    if min(grey.shape[1:]) < 3:
        return np.zeros(len(grey))
    lap = grey[:, :-2, 1:-1] + grey[:, 2:, 1:-1] + grey[:, 1:-1, :-2] + grey[:, 1:-1, 2:] - 4 * grey[:, 1:-1, 1:-1]
    return lap.var(axis=(1, 2))


def difference_hash(grey: np.ndarray) -> np.ndarray:
    """64 bits of each picture: resized to 8 rows of 9, bit 8 y + x is set where a pixel is brighter than its right neighbour."""
    small = resize(grey, 8, 9)
    bits = (small[:, :, :-1] > small[:, :, 1:]).reshape(len(grey), 64)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def exposure(grey: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean, standard deviation, share of pixels at most 30, share of at least 225 of each picture."""
    ax = (1, 2)
    return grey.mean(axis=ax), grey.std(axis=ax), (grey <= 30).mean(axis=ax), (grey >= 225).mean(axis=ax)


def flat_share(rgb: np.ndarray, block: int = 16, below: float = 25.0) -> np.ndarray:
    """Share of whole blocks whose variance is below the limit in each channel."""
    h, w = rgb.shape[1] // block, rgb.shape[2] // block
    if not h or not w:
        return np.zeros(len(rgb))
    b = rgb[:, : h * block, : w * block].reshape(len(rgb), h, block, w, block, 3)
    return (b.var(axis=(2, 4)) < below).all(axis=-1).mean(axis=(1, 2))


def has_bars(rgb: np.ndarray, share: float = 0.05, below: float = 100.0, least: int = 50) -> np.ndarray:
    """Whether the strips at top and bottom are of one colour, on pictures of at least `least` pixels a side."""
    if min(rgb.shape[1:3]) < least:
        return np.zeros(len(rgb), bool)
    k = max(1, int(rgb.shape[1] * share))
    even = lambda s: (s.reshape(len(s), -1, 3).var(axis=1) < below).all(axis=1)
    return even(rgb[:, :k]) & even(rgb[:, -k:])


def _by_shape(pictures: DataFrame, record_id: str, pixels: str, width: str, height: str, channels: int, measure: Callable, schema: str) -> DataFrame:
    """(record_id, *schema): `measure` of the pictures, those of one shape in an Arrow batch together; nulls where the pixels don't fit their size."""
    rows = pictures.select(
        F.col(record_id).cast("bigint").alias("record_id"), F.col(pixels).cast("array<double>").alias("p"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h")
    )
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("p")
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(n) - n
            flat = column.flatten()
            holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else np.zeros(0, np.int64)
            values = flat.to_numpy(zero_copy_only=False)
            w, h = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in "wh")
            whole = np.searchsorted(holes, begin) == np.searchsorted(holes, begin + n)
            ok = (w > 0) & (h > 0) & (w * h * channels == n) & whole
            out = [[None] * batch.num_rows for _ in names]
            for size in set(zip(w[ok].tolist(), h[ok].tolist(), strict=True)):
                at = np.flatnonzero(ok & (w == size[0]) & (h == size[1]))
                shape = (len(at), size[1], size[0], 3) if channels == 3 else (len(at), size[1], size[0])
                found = measure(values[begin[at][:, None] + np.arange(n[at[0]])].reshape(shape))
                for col, v in zip(out, found, strict=True):
                    for k, x in zip(at.tolist(), v.tolist(), strict=True):
                        col[k] = x
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["record_id", *names])

    return rows.mapInArrow(run, "record_id bigint, " + schema)


def picture_measures(pictures: DataFrame, record_id: str, pixels: str, width: str, height: str) -> DataFrame:
    """(record_id, blur_score, dhash, brightness, contrast, dark_share, bright_share) of grey pictures.

    pixels: ARRAY of height x width values 0 to 255, row by row. Null pixels or sizes that don't fit give null measures.
    """

    def measure(g: np.ndarray):
        small = shrink(g)
        return laplacian_variance(small), difference_hash(g), *exposure(small)

    return _by_shape(pictures, record_id, pixels, width, height, 1, measure, "blur_score double, dhash bigint, brightness double, contrast double, dark_share double, bright_share double")


def picture_signals(pictures: DataFrame, record_id: str, pixels: str, width: str, height: str) -> DataFrame:
    """(record_id, flat_share, has_bars) of RGB pictures: what functions.media.screenshot_score() needs of their pixels.

    pixels: ARRAY of height x width x 3 values 0 to 255, row by row. Null pixels or sizes that don't fit give null signals.
    """
    return _by_shape(pictures, record_id, pixels, width, height, 3, lambda rgb: (flat_share(rgb), has_bars(rgb)), "flat_share double, has_bars boolean")
