"""Scoring an archive that keeps growing.

Each micro-batch is a plain DataFrame, so the batch job runs on it unchanged; a
streaming aggregation per document is neither needed nor wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.staging import shuffle_width
from ..sources.archive import FILE_NAME, parse_archive_lines, write_predictions

ScoreFn = Callable[[DataFrame], DataFrame]
"""(newspaper, year, id, date, raw_text) -> (newspaper, year, id, date, label)."""


def archive_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
        .load(f"{path.rstrip('/')}/*/*.txt.gz")
    )
    from_path = lambda g: F.regexp_extract(F.col("_metadata.file_path"), FILE_NAME, g)
    named = lines.select("value", from_path(1).alias("newspaper"), from_path(2).cast("int").alias("year"))
    return parse_archive_lines(named)


def score_stream(rows: DataFrame, score: ScoreFn, out: str, checkpoint: str, once: bool = False):
    """Start scoring; a batch that is retried replaces its own output folder."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # gzip files arrive as one partition each
        even = batch.repartition(shuffle_width(batch))
        write_predictions(score(even), f"{out.rstrip('/')}/batch={batch_id}", mode="overwrite")

    writer = rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
