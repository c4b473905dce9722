"""Distances and lookup keys of coordinates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_MILES = 3958.8


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(a))


def gps_point(lat: Column, lon: Column) -> Column:
    """struct(lat, lon), null unless both are known."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


@F.pandas_udf(T.StringType())
def geocode_key(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """'lat:lon' with two decimals, rounded from the exact binary value (built-in formatting rounds the decimal text half up)."""
    return pd.Series([None if a != a or b != b else f"{a:.2f}:{b:.2f}" for a, b in zip(lat.astype(float), lon.astype(float), strict=True)], dtype=object)
