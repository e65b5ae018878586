"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A ledger is a folder of batches.  A batch holds signed rows (one for each document and tokenizer
version: +1 with the new count, -1 with the old one) and their rollup.  Totals are the sum of the
rollups of all committed batches, so a change costs its own size, never a recount.  A batch is
committed when its rollup has been written completely; committing it again changes nothing, and what
a lost driver left half written is written anew.

A deletion or revision takes back what was known when it was built.  It names the batches it was built
on, and a batch built on an older state than the ledger's is refused: it must be built again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe_codec import encoder
from .common import column, slices

KEYS = ["source", "lang", "tokenizer"]
SIGNED = "doc_id bigint, source string, lang string, tokenizer string, sign int, n_tokens bigint"
ROLLUP = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every row of ``docs``, for every tokenizer version.

    ``versions`` maps a version's name to its file of ranks.  Null and empty texts have no tokens but
    count as documents.  Other columns are ignored.
    """
    names = list(versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(versions[name]).encoding for name in names]
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in column(batch, "text").to_pylist()]
                counts = [[len(e.encode_ordinary(t)) for e in encoders] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, c) for c in ("doc_id", "source", "lang")), pa.array(counts, pa.list_(pa.int64()))],
                    names=["doc_id", "source", "lang", "counts"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in KEYS[:2]), "text")
    counted = rows.mapInArrow(run, "doc_id bigint, source string, lang string, counts array<bigint>")
    return counted.select("doc_id", "source", "lang", F.explode(F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("tokenizer"), F.col("counts").alias("n_tokens"))).alias("x")).select(
        "doc_id", "source", "lang", F.col("x.tokenizer").alias("tokenizer"), F.col("x.n_tokens").alias("n_tokens"))


class StaleBatch(ValueError):
    """A batch that takes back what is no longer the ledger's state."""


class Ledger:
    """Signed changes and their rollups under ``folder``, a place that every executor reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, batch: str = "") -> str:
        return f"{self.folder}/{kind}/{batch}".rstrip("/")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def committed(self) -> list[str]:
        files, at = self._files(self._path("rollup"))
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted(n for n in names if self._done(n))

    def _done(self, batch: str) -> bool:
        files, at = self._files(self._path("rollup", batch) + "/_SUCCESS")
        return bool(files.exists(at))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add the signed rows as one batch; False if a batch of this name is already committed.

        Rows built on another state of the ledger (``StaleBatch``) are not added.  One writer commits at a time.
        """
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._done(batch):
            return False
        built = [c for c in ("built_on",) if c in signed.columns]
        signed.select(*[c.split()[0] for c in SIGNED.split(", ")], *built).write.mode("overwrite").parquet(self._path("signed", batch))
        if built:
            # at most a few names of states; without a rollup the rows just written never count
            states = self.spark.read.parquet(self._path("signed", batch)).select("built_on").where("built_on IS NOT NULL").distinct()
            if any(r["built_on"] != self.state() for r in states.limit(2).collect()):
                raise StaleBatch(f"{batch!r} was built on an older state of the ledger; build it again")
        rows = self.spark.read.schema(SIGNED).parquet(self._path("signed", batch))
        # partial sums first: a hot source costs one row a task
        rollup = rows.groupBy(*KEYS).agg(
            F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        rollup.write.mode("overwrite").parquet(self._path("rollup", batch))
        return True

    def state(self) -> str:
        """Name of the ledger's state: changes with every commit."""
        return hashlib.md5("/".join(self.committed()).encode()).hexdigest()

    def _all(self, kind: str, schema: str) -> DataFrame:
        paths = [self._path(kind, b) for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self, ids: DataFrame | None = None) -> DataFrame:
        """What the committed batches say of each document: (doc_id, source, lang, tokenizer, n_docs, n_tokens).

        With ``ids`` (doc_id) only their signed rows are looked at: the others leave before the grouping.
        """
        signed = self._all("signed", SIGNED)
        if ids is not None:
            signed = signed.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return signed.groupBy("doc_id", *KEYS).agg(
            F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"),
        ).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._all("rollup", ROLLUP).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def insertions(self, counts: DataFrame) -> DataFrame:
        """Signed rows for new documents; repeated rows count one by one."""
        return counts.withColumn("sign", F.lit(1))

    def deletions(self, ids: DataFrame) -> DataFrame:
        """Signed rows that take back all that is known of the documents in ``ids`` (doc_id).

        Unknown ids change nothing; a null id deletes nothing; an id given twice deletes once.
        """
        known = self.documents(ids)
        # a document stored n times leaves n times; its tokens leave with the first row
        times = known.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_docs"))))
        return times.select(
            "doc_id", *KEYS, F.lit(-1).alias("sign"),
            F.when(F.col("k") == 1, F.col("n_tokens")).otherwise(0).alias("n_tokens"), F.lit(self.state()).alias("built_on"))

    def revisions(self, counts: DataFrame) -> DataFrame:
        """Signed rows that replace what is known of the documents in ``counts`` by their new counts."""
        added = self.insertions(counts).withColumn("built_on", F.lit(self.state()))
        return self.deletions(counts.select("doc_id")).unionByName(added)
