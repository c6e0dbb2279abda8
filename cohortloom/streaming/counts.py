"""Person counts over a stream: the categories of a count table in tumbling windows, with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import category


def windowed_counts(stream: DataFrame, time: str, width: str, categories: Mapping, late: str = "1 hour") -> DataFrame:
    """COUNT by window start and category; state older than the watermark is dropped. Works on static frames too."""
    cats = [category(stream, k, v) for k, v in categories.items()]
    out = stream.withWatermark(time, late).select(F.col(time), *[c.alias(n) for n, c, _ in cats])
    out = out.groupBy(F.window(time, width).alias("_w"), *[n for n, _, _ in cats]).agg(F.count("*").alias("COUNT"))
    return out.select(F.col("_w.start").alias("window_start"), *[n for n, _, _ in cats], "COUNT")
