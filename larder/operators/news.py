"""Recent news per topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.functions import text
from larder.operators import scale

MAX_CHARS = 1000


def preview(articles: DataFrame) -> DataFrame:
    """Display fields with defaults; the preview is cut from the first 1000 characters."""
    body = text.clip(F.coalesce("content", F.lit("")), MAX_CHARS)
    return articles.withColumns({
        "title": F.coalesce("title", F.lit("Untitled")),
        "source": F.coalesce("source", F.lit("Unknown")),
        "published_text": F.coalesce(F.date_format("published", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")),
        "preview": text.preview(body),
    })


def latest(articles: DataFrame, as_of: str, k: int = 5, days: int = 7) -> DataFrame:
    """The `k` newest articles per topic of the last `days` days."""
    end = F.lit(as_of).cast("timestamp")
    recent = articles.filter(F.col("published") >= end - F.expr(f"INTERVAL {int(days)} DAYS"))
    return preview(scale.ranked(recent, ["topic"], [F.desc("published"), F.col("url")], k))


def totals(articles: DataFrame) -> DataFrame:
    return articles.groupBy("topic").agg(F.count(F.lit(1)).alias("total_results"))
