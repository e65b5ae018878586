"""From long features to the vectors the Spark ML estimators need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.lookup import lookup
from ..plans.staging import settle

BUCKETS = 1024


def dense_index(features: DataFrame, name: str = "feature") -> DataFrame:
    """(feature, idx): every distinct feature gets a number 0..m-1.

    Numbers are given per hash bucket and shifted by the sizes of the buckets
    before, so no task orders the whole vocabulary.
    """
    distinct = features.select(name).distinct().withColumn(
        "bucket", F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")
    )
    ranked = distinct.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(name)))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )  # at most BUCKETS rows
    return ranked.join(F.broadcast(offsets), "bucket").select(
        name, (F.col("offset") + F.col("rn") - 1).cast("int").alias("idx")
    )


@dataclass
class VectorSpace:
    """Feature names and their positions."""

    index: DataFrame  # feature, idx
    size: int

    def vectors(self, features: DataFrame, docs: DataFrame) -> DataFrame:
        """(*docs, features): a sparse vector per document, empty where nothing is known."""
        size = self.size

        @F.udf(VectorUDT(), useArrow=True)
        def sparse(indices, values):
            return SparseVector(size, list(indices), list(values))

        placed = lookup(features.select("doc_id", "feature", "value"), self.index, "feature", self.size)
        pairs = placed.where(F.col("value") != 0).groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("p")  # one document
        )
        joined = docs.join(pairs, "doc_id", "left").withColumn(
            "p", F.coalesce("p", F.array().cast("array<struct<idx:int,value:double>>"))
        )
        return joined.select(*docs.columns, sparse(F.col("p.idx"), F.col("p.value")).alias("features"))


def fit_vector_space(features: DataFrame) -> VectorSpace:
    index = settle(dense_index(features))
    return VectorSpace(index, index.count())


def dense_vectors(rows: DataFrame, column: str, out: str = "features") -> DataFrame:
    return rows.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))
