"""Shapes of pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Screen sizes in pixels, either way round, and aspect ratios of cameras.
SCREEN_SIZES = [
    (1170, 2532), (1179, 2556), (1125, 2436), (1242, 2688), (1284, 2778), (1290, 2796), (750, 1334), (828, 1792), (1080, 1920), (640, 1136),
    (1080, 2400), (1080, 2340), (1440, 3200), (1440, 3120), (1440, 2960), (1080, 2280), (2048, 2732), (1668, 2388), (1620, 2160),
    (1920, 1080), (2560, 1440), (3840, 2160), (1366, 768), (1440, 900), (2560, 1600), (3024, 1964),
]
CAMERA_RATIOS = [4 / 3, 3 / 2, 16 / 9, 1.0]
RATIO_TOLERANCE = 0.03


def is_screen_size(width: Column, height: Column) -> Column:
    key = F.concat_ws("x", F.least(width, height).cast("string"), F.greatest(width, height).cast("string"))
    return F.coalesce((width.isNotNull() & height.isNotNull()) & key.isin([f"{min(s)}x{max(s)}" for s in SCREEN_SIZES]), F.lit(False))


def is_camera_ratio(width: Column, height: Column) -> Column:
    ratio = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0))
    fits = [F.abs(ratio - F.lit(r)) < RATIO_TOLERANCE for r in CAMERA_RATIOS]
    return F.coalesce((width > 0) & (height > 0) & (fits[0] | fits[1] | fits[2] | fits[3]), F.lit(False))


def screenshot_score(width: Column, height: Column, has_camera: Column, flat_share: Column, has_bars: Column) -> Column:
    """How much a picture looks like a screenshot, 0 to 1, from its shape, camera and flat regions."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    score = (
        flag(is_screen_size(width, height), 0.3)
        + flag(~has_camera, 0.25)
        + flag(flat_share > 0.4, 0.2)
        + flag(flat_share > 0.6, 0.15)
        + flag(has_bars, 0.15)
        + flag(~is_camera_ratio(width, height) & (width > 100) & (height > 100), 0.1)
    )
    return F.least(score, F.lit(1.0))


def is_not_a_photo(kind: Column, confidence: Column) -> Column:
    """Whether an outside answer says so with high or medium confidence."""
    return F.lower(kind).isin("screenshot", "meme", "graphic", "document") & F.lower(confidence).isin("high", "medium")
