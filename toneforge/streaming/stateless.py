"""The per-row functions on streams: any of them is valid in a streaming query unchanged. What follows is for convenience."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def normalized(stream: DataFrame, text: str = "text") -> DataFrame:
    """A stream with canonical and base text and noise counts."""
    return stream.withColumn("canonical", T.canon(F.col(text))).withColumn("base", T.strip_to_base(F.col(text))).withColumn("noise", T.noise(F.col(text)))


def windowed_noise(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes", text: str = "text") -> DataFrame:
    """Noise summed over event-time windows; rows later than late fall out."""
    n = T.noise(F.col(text))
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("texts"), *(F.sum(n[k]).alias(k) for k in T.NOISE))
