"""The annotation cache as a store: committed appends, entries by hash prefix, one entry per text.

Layout below the store's folder:

  entries/batch=<name>/prefix=<first digits of the hash>/*.parquet
  commits/<number>     one line: {"batch": name, "replaces": [names]}

An append writes its entries first and counts from the moment its commit file exists.  Commit files are
made exclusively, one number after the other, so of two appends at once one comes first, for every later
reader the same.  Of several entries of a text the one committed first is the text's entry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..plans.lookup import lookup
from ..plans.staging import settle
from .annotation import ANNOTATED, TOKEN_BYTES, annotate

DIGITS = 2                 # 256 folders a batch
ENTRIES = f"prefix string, batch string, {ANNOTATED}"
Tagger = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass
class AnnotationStore:
    spark: SparkSession
    path: str
    digits: int = DIGITS

    # --- commits ----------------------------------------------------------------------

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commits(self) -> list[dict]:
        """All commits in order; one short line each."""
        files, folder = self._files("commits")
        if not files.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(folder) if not s.getPath().getName().startswith((".", "_")))
        found = []
        for name in names:
            stream = files.open(self._files(f"commits/{name}")[1])
            try:
                found.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return found

    def batches(self) -> list[str]:
        """Names of the batches that count, first committed first."""
        commits = self._commits()
        gone = {name for c in commits for name in c["replaces"]}
        return [c["batch"] for c in commits if c["batch"] not in gone]

    def _commit(self, batch: str, replaces: list[str]) -> None:
        number = len(self._commits())
        while True:
            files, path = self._files(f"commits/{number:012d}")
            try:
                stream = files.create(path, False)   # fails if another append took the number
            except Exception as taken:  # noqa: BLE001
                if not files.exists(path):
                    raise
                del taken
                number += 1
                continue
            stream.write(bytearray(json.dumps({"batch": batch, "replaces": replaces}).encode()))
            stream.close()
            return

    # --- entries ----------------------------------------------------------------------

    def entries(self, prefixes: list[str] | None = None) -> DataFrame:
        """(prefix, sha, tokens) of every text; ``prefixes`` restricts the folders that are read."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], ENTRIES).drop("batch")
        rows = self.spark.read.schema(ENTRIES).parquet(f"{self.path.rstrip('/')}/entries").where(F.col("batch").isin(names))
        if prefixes is not None:
            rows = rows.where(F.col("prefix").isin(prefixes))
        if len(names) == 1:
            return rows.drop("batch")
        order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("batch"))
        return rows.groupBy("prefix", "sha").agg(F.min_by("tokens", order).alias("tokens"))

    def _hashed(self, docs: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
        """``docs`` with ``sha``, and the prefixes it needs: at most 16 to the power of ``digits``."""
        hashed = docs.withColumn("sha", tx.hash_text(F.col(text)))
        wanted = hashed.select(F.substring("sha", 1, self.digits).alias("p")).where("p IS NOT NULL").distinct().collect()
        return hashed, sorted(r["p"] for r in wanted)

    def hits(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(*docs, sha, tokens) of the documents whose text has an entry."""
        hashed, prefixes = self._hashed(docs, text)
        found = self.entries(prefixes).select("sha", "tokens")
        rows, mean, largest = found.agg(F.count(F.lit(1)), F.avg(F.size("tokens")), F.max(F.size("tokens"))).first()
        width = lambda n: 128 + TOKEN_BYTES * int(n or 0)
        return lookup(hashed, found, "sha", rows, bytes_per_row=width(mean), widest_row=width(largest))

    def misses(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(sha, text): one row per distinct text without an entry."""
        hashed, prefixes = self._hashed(docs.select(text), text)
        distinct = hashed.where("sha IS NOT NULL").groupBy("sha").agg(F.first(text).alias("text"))
        return distinct.join(self.entries(prefixes).select("sha"), "sha", "left_anti")

    # --- changes ----------------------------------------------------------------------

    def append(self, annotated: DataFrame, replaces: list[str] | None = None) -> str:
        """Write (sha, tokens), then commit; what fails before the commit is never read."""
        batch = uuid.uuid4().hex
        annotated.select("sha", "tokens", F.substring("sha", 1, self.digits).alias("prefix")).repartition("prefix").write.partitionBy(
            "prefix").parquet(f"{self.path.rstrip('/')}/entries/batch={batch}")
        self._commit(batch, replaces or [])
        return batch

    def annotate(self, docs: DataFrame, tagger: Tagger, text: str = "text") -> str | None:
        """Tag the texts without an entry and append them; None if there were none."""
        new = settle(annotate(self.misses(docs, text), tagger))
        return None if new.isEmpty() else self.append(new)

    def compact(self) -> str | None:
        """One batch instead of all; the old ones stay on disk until ``vacuum``."""
        names = self.batches()
        return self.append(self.entries(), names) if len(names) > 1 else None

    def vacuum(self) -> None:
        """Delete the folders of replaced batches; no reader may still use them."""
        for name in {name for c in self._commits() for name in c["replaces"]}:
            files, folder = self._files(f"entries/batch={name}")
            files.delete(folder, True)
