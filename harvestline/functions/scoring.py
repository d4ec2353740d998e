"""Closed-form procurement score and its terms, as plain column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.constants import SCORE_WEIGHTS

PRICE_NORM = "price_norm"


def score_terms() -> dict[str, Column]:
    """The seven terms, from feature columns and the normalised price."""
    price_excess = F.greatest(F.col(PRICE_NORM) - 0.9, F.lit(0.0))
    pack_distance = F.log10("pack_size_g") - 2.0
    return {
        "price": F.exp(-1.2 * price_excess),
        "pack": F.exp(-0.35 * pack_distance * pack_distance),
        "lead": F.exp(-F.col("lead_time_days") / 15.0),
        "reliability": 0.6 * F.col("on_time_pct") + 0.4 * F.col("quality_score"),
        "urgency": F.tanh(F.col("demand_1h_trays") / 40.0),
        "trend": 0.5 + 0.5 * F.tanh(20.0 * F.col("input_pct_24h")),
        "organic": 0.5 + 0.5 * F.col("organic_cert_int"),
    }


def score() -> Column:
    """Weighted sum of the terms, clipped to 0..1."""
    total = reduce(add, [F.lit(SCORE_WEIGHTS[n]) * term for n, term in score_terms().items()])
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def with_price_norm(features: DataFrame) -> DataFrame:
    """Price relative to the mean price of all rows.

    The mean is a scalar subquery: partial sums on every task, one value back, no window
    over the whole table and no join.
    """
    mean = features.agg(F.avg("usd_per_gram")).scalar()
    return features.withColumn(PRICE_NORM, F.try_divide(F.col("usd_per_gram"), mean))


def score_closed_form(features: DataFrame) -> DataFrame:
    """Add `score`; the default scorer of the leaderboard."""
    return with_price_norm(features).withColumn("score", score()).drop(PRICE_NORM)


def explain_score(features: DataFrame) -> DataFrame:
    """Add one `<name>_term` column per term and the score itself."""
    named = {f"{name}_term": term for name, term in score_terms().items()}
    return with_price_norm(features).withColumns({**named, "score": score()})
