"""Scoring terms, the trained scorer and its versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from harvestline.checks import gold as views
from harvestline.checks.registry import Tables, query
from harvestline.constants import FEATURES
from harvestline.functions import scoring
from harvestline.operators import aggregates
from harvestline.plans import boosting, gold, model
from harvestline.session import scratch_path

# trees fitted by this session, per application and data folder: one table of 7,751 nodes at most
_FITTED: dict[tuple[str, str], list] = {}

_TERMS = ["price", "pack", "lead", "reliability", "urgency", "trend", "organic"]


@query("procurement_score", "SELECT sku, supplier_id, R(score) AS score FROM scored_offers")
def procurement_score(t: Tables):
    return scoring.score_closed_form(views.stored_features(t)).select("sku", "supplier_id", "score")


@query("score_terms", f"""
    SELECT sku, supplier_id, {', '.join(f'R({n}_term) AS {n}_term' for n in _TERMS)}
    FROM scored_offers""")
def score_terms(t: Tables):
    return scoring.explain_score(views.stored_features(t)).select(
        "sku", "supplier_id", *[f"{n}_term" for n in _TERMS])


@query("training_set", f"""
    SELECT {', '.join(f'R({c}) AS {c}' for c in FEATURES)}, R(score) AS label
    FROM scored_offers""", round_to=8)
def training_set(t: Tables):
    return model.training_set(views.stored_features(t))


@query("feature_order", """
    SELECT sku, supplier_id, R(lead_time_days) AS lead_time_days, R(min_qty) AS min_qty,
           R(demand_1h_trays) AS demand_1h_trays FROM supplier_features""")
def feature_order(t: Tables):
    ordered = model.check_features(views.stored_features(t))
    assert ordered.columns[:len(FEATURES)] == FEATURES
    return ordered.select("sku", "supplier_id", "lead_time_days", "min_qty", "demand_1h_trays")


def _closed_form_in_python():
    """The closed-form score as a Python model over Arrow batches."""
    def run(x):
        trend = 0.5 + 0.5 * np.tanh(x["input_pct_24h"] * 20)
        total = (
            0.30 * np.exp(-1.2 * np.maximum(x["price_norm"] - 0.9, 0))
            + 0.10 * np.exp(-0.35 * (np.log10(x["pack_size_g"]) - 2) ** 2)
            + 0.15 * np.exp(-x["lead_time_days"] / 15)
            + 0.20 * (0.6 * x["on_time_pct"] + 0.4 * x["quality_score"])
            + 0.10 * np.tanh(x["demand_1h_trays"] / 40)
            + 0.10 * trend
            + 0.05 * (0.5 + 0.5 * x["organic_cert_int"])
        )
        return total.clip(0, 1)

    return run


@query("vectorised_score_udf", "SELECT sku, supplier_id, R(score) AS score FROM scored_offers")
def vectorised_score_udf(t: Tables):
    score = model.vectorised_scorer(_closed_form_in_python, extra=[scoring.PRICE_NORM])
    return score(scoring.with_price_norm(views.stored_features(t))).select(
        "sku", "supplier_id", "score")


def _fit(t: Tables) -> boosting.Boosted:
    """250 trees, the defaults of `fit`, on four fifths of all offers."""
    labelled = scoring.score_closed_form(views.stored_features(t)).withColumnRenamed("score", "label")
    rows = model.check_features(labelled).select(*FEATURES, "sku", "supplier_id", "label")
    fitted = boosting.fit(rows, scratch_path(t.spark, "boosted"), "fit", fitted=~model.held_out())
    _FITTED[t.spark.sparkContext.applicationId, t.folder] = fitted.trees.collect()
    return fitted


def _trees(t: Tables):
    """The trees of this folder, fitted once a session however many queries use them."""
    key = t.spark.sparkContext.applicationId, t.folder
    if key not in _FITTED:
        _fit(t)
    return t.spark.createDataFrame(_FITTED[key], boosting.NODES)


@query("boosted_scores", "SELECT sku, supplier_id, R(score) AS label, true AS agrees FROM scored_offers")
def boosted_scores(t: Tables):
    """Every offer with its label, and whether walking the table of trees gives what the learner's own
    trees added up to while they were fitted."""
    fitted = _fit(t)
    summed = F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
    return boosting.score(fitted.rows, fitted.trees).select(
        "sku", "supplier_id", "label", (F.abs(F.col("score") - summed) < 1e-9).alias("agrees"))


@query("gbt_train_score")
def gbt_train_score(t: Tables):
    """Suppliers ranked by a scorer trained on the same feature table."""
    trees = _trees(t)
    return gold.supplier_leaderboard(views.stored_features(t), scorer=lambda df: boosting.score(df, trees))


@query("model_mae")
def model_mae(t: Tables):
    """Mean absolute error over the offers that no tree has seen."""
    test = model.training_set(views.stored_features(t)).where(model.held_out())
    return aggregates.mean_absolute_error(boosting.score(test, _trees(t)), "label", "score")


@query("model_versions")
def model_versions(t: Tables):
    """Half the trees are saved as version 1, all as version 2; `prod` moves to the second, which scores."""
    root, name = scratch_path(t.spark, "models"), "supplier_scoring_model"
    trees = _trees(t)
    for version, saved in ((1, trees.where("tree <= 125")), (2, trees)):
        model.save_trees(saved, root, version)
        model.move_alias(t.spark, root, name, "prod", version)
    version = model.resolve_alias(t.spark, root, name, "prod")
    return boosting.score(views.stored_features(t), model.load_trees(t.spark, root, name)).select(
        "sku", "supplier_id", "score", F.lit(version).alias("model_version"))
