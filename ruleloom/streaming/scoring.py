"""Streaming uses of a learned rule set: scoring arriving rows, and windowed supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST_RULES = 10_000


def predict_stream(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rid, items`` of streaming rows ``(rid, items)``: tails of the rules whose head a row contains.

    The rule set is sent to every task; more than ``MOST_RULES`` rules raise ``ValueError``.
    """
    if model.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hit = rows.join(F.broadcast(model.select("head", "tail")), F.size(F.array_except("head", "items")) == 0)
    return hit.select("rid", F.explode("tail").alias("item"))


def windowed_support(events: DataFrame, time: str, item: str, width: str, late: str) -> DataFrame:
    """``start, item, support`` per tumbling window, with events up to ``late`` behind the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), F.col(item).alias("item")).agg(F.count("*").alias("support")).select("window.start", "item", "support")
