"""Vectors, costs and other arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def clamped_cosine(a: Column, b: Column) -> Column:
    """For unit vectors."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def is_unit(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(F.sqrt(dot(v, v)) - 1) <= tolerance


def softmax_yes(yes: Column, no: Column) -> Column:
    """Probability of the first of two logits."""
    return 1 / (1 + F.exp(no - yes))


#: Shares of the input rate for cache reads and writes, and the batch tier's share of the whole.
CACHE_READ, CACHE_WRITE, BATCH = 0.10, 1.25, 0.50


def model_alias(model: Column) -> Column:
    return F.regexp_replace(model, r"-\d{8}$", "")


def usd(tokens_in: Column, cache_read: Column, cache_write: Column, tokens_out: Column, rate_in: Column, rate_out: Column, tier: Column) -> Column:
    """Cost of a message; rates are per million tokens; null cache counts are none."""
    m = F.lit(1_000_000.0)
    read, write = F.coalesce(cache_read, F.lit(0)), F.coalesce(cache_write, F.lit(0))
    cost = tokens_in / m * rate_in + read / m * rate_in * CACHE_READ + write / m * rate_in * CACHE_WRITE + tokens_out / m * rate_out
    return F.when(tier == "batch", cost * BATCH).otherwise(cost)


def confidence_number(c: Column) -> Column:
    """Categories to numbers, for projections that need them."""
    return F.when(c == "high", 1.0).when(c == "medium", 0.6).when(c == "low", 0.3)


def cost_bps(spread_bps: Column, participation: Column, impact: float = 10.0) -> Column:
    """Half-spread and a square-root impact, in basis points."""
    return spread_bps + F.lit(impact) * F.sqrt(participation)
