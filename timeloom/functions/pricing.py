"""Costs and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates in USD.
VIDEO_PER_SEC, AUDIO_PER_SEC = 0.00025, 0.0001
TOKENS_BASE, TOKENS_PER_IMAGE, TOKENS_OUT = 800, 1100, 1200
FALLBACK_IN, FALLBACK_OUT = 3.0, 15.0


def media_cost(seconds: Column, audio: Column, passes: Column) -> Column:
    return seconds * F.when(audio, AUDIO_PER_SEC).otherwise(VIDEO_PER_SEC) * passes


def image_cost(n_images: Column, usd_in: Column, usd_out: Column) -> Column:
    """Estimate of one request over n images; a missing or zero price falls back to the default."""
    price = lambda c, d: F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(d)).otherwise(c)
    tokens_in = TOKENS_BASE + TOKENS_PER_IMAGE * n_images
    return F.bround((tokens_in * price(usd_in, FALLBACK_IN) + TOKENS_OUT * price(usd_out, FALLBACK_OUT)) / 1e6, 4)


def per_million(per_token: Column) -> Column:
    """USD per million tokens from a text of USD per token; null if it is no number or negative."""
    x = per_token.try_cast("double")
    return F.when(x >= 0, F.bround(x * 1e6, 4))


def show_context(tokens: Column) -> Column:
    return F.when(tokens.isNull(), "-").when(tokens >= 1000, F.format_string("%dK", F.floor(tokens / 1000).cast("long"))).otherwise(tokens.cast("string"))


def show_price(usd: Column) -> Column:
    return F.when(usd.isNull(), "-").otherwise(F.format_string("$%.4f", usd))


def add_known(a: Column, b: Column) -> Column:
    """a + b if both are known, else b."""
    return F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(b)


def sum_or_null(x: Column) -> Column:
    """Sum that is null as soon as one input is."""
    return F.when(F.count("*") == F.count(x), F.sum(x))


def retryable(status: Column) -> Column:
    """Requests worth repeating: no status at all, or one of these (fixed values)."""
    return status.isNull() | status.isin(408, 409, 429, 500, 502, 503, 504)
