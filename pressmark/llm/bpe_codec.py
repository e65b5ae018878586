"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into windows that overlap.  Every window is pre-tokenised on its own, wherever it
starts.  The pattern never looks back, so from the first boundary that two neighbouring windows
share they agree on everything that follows: the windows are stitched there, and only pieces
between stitching points are kept.  Windows of one long text are encoded by different tasks.

Texts of at most ``window`` characters are one window and never move.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary, column, slices

WINDOW = 32_768
OVERLAP = 1_024
CACHED_PIECES = 100_000
CACHED_LENGTH = 32

ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
_state: dict = {}


class Encoder:
    """Pieces of the public pre-token pattern and their ids; frequent pieces come from a bounded cache."""

    def __init__(self, ranks_path: str):
        self.ranks_path = ranks_path
        self.cache: dict[str, tuple[int, ...]] = {}

    def ranks(self) -> dict[bytes, int]:
        with open(self.ranks_path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    # each part is made by the workers that need it

    @cached_property
    def encoding(self):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks(), special_tokens={})

    @cached_property
    def pattern(self):
        import public_tokenizers
        import regex

        return regex.compile(public_tokenizers.PATTERN)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        ranks = self.ranks()
        found = [b""] * (max(ranks.values()) + 1)
        for part, i in ranks.items():
            found[i] = part
        return found

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.cache.get(text)
        if ids is None:
            # one piece is one match of the pattern, so encoding it alone splits it no further
            ids = tuple(self.encoding.encode_ordinary(text))
            if len(text) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED_PIECES:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def window(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Start of every piece, its number of ids, and all ids."""
        starts, counts, ids, at = [], [], [], 0
        for p in self.pattern.findall(text):
            got = self.piece(p)
            starts.append(at)
            counts.append(len(got))
            ids.extend(got)
            at += len(p)
        return starts, counts, ids

    def decode(self, ids: bytes) -> bytes:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


def encoder(ranks_path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if ranks_path not in _state:
        _state[ranks_path] = Encoder(ranks_path)
    return _state[ranks_path]


def settled_end(text: str) -> int:
    """Boundaries up to here do not depend on what follows the window.

    Only the last run of white space, or of anything else, could be continued by unseen text.
    """
    n = len(text)
    if not n:
        return 0
    space = text[-1].isspace()
    at = n
    while at and text[at - 1].isspace() == space:
        at -= 1
    return at


def _ids_bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encode(docs: DataFrame, ranks_path: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit.

    A null or empty text has no ids.  A row with a null doc_id is encoded like any other.  Repeated
    rows give one row each.  Other columns are ignored.
    """
    if overlap >= window:
        raise ValueError("the overlap must be shorter than the window")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > window

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                got = [_ids_bytes(enc.encoding.encode_ordinary(t.as_py())) for t in column(batch, "text")]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), pa.array([len(g) // 4 for g in got], pa.int64()), binary(got)],
                    names=["doc_id", "n_tokens", "ids"])

    short = rows.where(~long).mapInArrow(whole, ENCODED)

    cut = rows.where(long).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("n"),
        F.expr(f"transform(sequence(0, cast((length(text) - 1) div {window} as int)), "
               f"w -> struct(w, substring(text, w * {window} + 1, {window + overlap}) as part))").alias("windows"),
    ).select("doc_id", "text_hash", "n", F.explode("windows").alias("x")).select(
        "doc_id", "text_hash", "n", "x.w", "x.part")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for whole_batch in batches:
            for batch in slices(whole_batch, "part"):
                found = [tuple(map(_ids_bytes, enc.window(t.as_py()))) for t in column(batch, "part")]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, c) for c in ("doc_id", "text_hash", "n", "w", "part")]
                    + [binary([f[k] for f in found]) for k in range(3)],
                    names=["doc_id", "text_hash", "n", "w", "part", "starts", "counts", "ids"])

    # many windows of one text are dealt to many tasks
    parts = cut.repartition("doc_id", "text_hash", "w").mapInArrow(
        each, cut.schema.simpleString()[7:-1] + ", starts:binary, counts:binary, ids:binary")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        # equal rows (same id, same text) bring every window as often as they are repeated
        copies = int((group["w"] == 0).sum())
        group = group.drop_duplicates("w").sort_values("w")
        ids = _ids_bytes(stitch(group, encoder(ranks_path), window))
        row = (None if pd.isna(group["doc_id"].iloc[0]) else int(group["doc_id"].iloc[0]), len(ids) // 4, ids)
        out = pd.DataFrame([row] * copies, columns=["doc_id", "n_tokens", "ids"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return short.unionByName(parts.groupBy("doc_id", "text_hash", "n").applyInPandas(join, ENCODED))


def stitch(group: pd.DataFrame, enc: Encoder, window: int) -> list[int]:
    """Ids of one text from its windows (w, part, starts, counts, ids), ordered by w.

    Two windows that share no boundary (one run of characters fills the whole overlap) are joined
    into one longer window, which is pre-tokenised again: no text is left to a guess.
    """
    windows: list[list] = []
    for w, part, s, c, i in zip(group["w"], group["part"], group["starts"], group["counts"], group["ids"], strict=True):
        here = [int(w) * window, part, *(np.frombuffer(x, "<u4").astype(np.int64) for x in (s, c, i)), 0]
        while windows:
            at, text, starts, _, _, begin = windows[-1]
            usable = starts[(starts <= settled_end(text)) & (starts + at >= begin)] + at
            common = np.intersect1d(usable, here[2] + here[0])
            if len(common):
                here[5] = int(common[0])
                break
            longer = text + here[1][at + len(text) - here[0]:]
            windows.pop()
            here = [at, longer, *(np.asarray(x, np.int64) for x in enc.window(longer)), 0]
        windows.append(here)
    ids: list[int] = []
    for k, (at, _, starts, counts, values, begin) in enumerate(windows):
        end = windows[k + 1][5] if k + 1 < len(windows) else None
        ends = np.concatenate([[0], np.cumsum(counts)])
        low = np.searchsorted(starts + at, begin)
        high = len(starts) if end is None else np.searchsorted(starts + at, end)
        ids.extend(values[ends[low]:ends[high]].tolist())
    return ids


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` plus ``decoded``, the bytes of its ids one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for whole_batch in batches:
            for batch in slices(whole_batch, "ids"):
                got = [enc.decode(x.as_py() or b"") for x in column(batch, "ids")]
                yield pa.RecordBatch.from_arrays([*batch.columns, binary(got)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.schema.simpleString()[7:-1] + ", decoded:binary")
