"""Scalers over long features (doc_id, feature, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..plans.lookup import broadcast_small, lookup
from ..plans.quantiles import exact_quantiles
from ..plans.staging import settle


@dataclass
class ScalerModel:
    """table(feature, shift, scale): value -> (value - shift) / scale."""

    table: DataFrame
    n_features: int

    def transform(self, features: DataFrame) -> DataFrame:
        joined = lookup(features, self.table, "feature", self.n_features, how="left")
        return joined.select(
            *[c for c in features.columns if c != "value"],
            ((F.col("value") - F.coalesce("shift", F.lit(0.0))) / F.coalesce("scale", F.lit(1.0))).alias("value"),
        )


def _model(table: DataFrame) -> ScalerModel:
    kept = settle(table)
    return ScalerModel(kept, kept.count())


def fit_iqr_scaler(features: DataFrame, n_docs: int | None = None) -> ScalerModel:
    """Divide by the 25-75 % range, no centring; a zero range leaves the column as it is.

    With ``n_docs`` the rows leave out zeros (TF-IDF weights, never negative): a
    feature present in at most a quarter of the documents has range 0, so only the
    frequent ones are ranked; all others are not even listed in the model.
    """
    rows = features.select(F.col("feature").alias("key"), F.col("value").cast("double").alias("value"))
    if n_docs is not None:
        frequent = (
            rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
            .where(F.col("df") > 0.25 * (n_docs - 1)).select("key")
        )
        # sum(df) = number of rows bounds this by 4 x features per document
        rows = rows.join(broadcast_small(settle(frequent)), "key", "left_semi")
    quartiles = exact_quantiles(rows, [0.25, 0.75], total=None if n_docs is None else F.lit(n_docs))
    iqr = F.col("q")[1] - F.col("q")[0]
    return _model(quartiles.select(
        F.col("key").alias("feature"), F.lit(0.0).alias("shift"), F.when(iqr > 0, iqr).otherwise(F.lit(1.0)).alias("scale")
    ))


def fit_unit_range_scaler(features: DataFrame, n_docs: int | None = None) -> ScalerModel:
    """Map every feature to [0, 1]; a constant feature becomes 0.

    With ``n_docs`` rows may leave out zeros: a feature with fewer rows than
    documents also has the value 0.
    """
    low, high = F.min("value"), F.max("value")
    if n_docs is not None:
        gaps = F.count("value") < n_docs
        low = F.when(gaps, F.least(low, F.lit(0.0))).otherwise(low)
        high = F.when(gaps, F.greatest(high, F.lit(0.0))).otherwise(high)
    bounds = features.groupBy("feature").agg(low.alias("low"), high.alias("high"))
    span = F.col("high") - F.col("low")
    return _model(bounds.select(
        "feature", F.col("low").alias("shift"), F.when(span > 0, span).otherwise(F.lit(1.0)).alias("scale")
    ))
