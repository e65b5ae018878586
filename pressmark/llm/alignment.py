"""Alignment of two tokenizers' tokens by interval coalescing.

Tokens of both tokenizers are intervals over one string of bytes.  All intervals of a block of documents
are sorted by start, the running maximum of their ends is kept, and a group ends where the next start
reaches it: that is where tokens of both sides end.  Within a group every token of one side is linked
with every token of the other.

A block is a megabyte of text and works alone.  It keeps its distinct linked id pairs once, and per
document the places of its pairs in that list.  Only the blocks' distinct pairs are shuffled: once to
count documents, once to bring the counts back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import binary, column, settled, slices

#: Fixed value: the pre-token pattern of the byte-level vocabulary's file.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 1 << 20
LINKS_AT_ONCE = 4_000_000
B_BITS = 20                # ids of the second tokenizer are below 2^20
DENSE = 64                 # groups with more links are reduced to distinct ids first

BLOCKS = ("block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
          "n_links array<bigint>, shas array<string>, bounds binary, places binary, times binary, pairs array<bigint>, holders array<int>")
ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
           "groups_sha256 string")
_state: dict = {}


class Tokenizers:
    """Ids and bytes of both sides; ``ranks_path`` holds the byte-level vocabulary as ranks, which encode several times faster."""

    def __init__(self, ranks_path: str, piece_path: str):
        self.ranks_path, self.piece_path = ranks_path, piece_path

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.ranks_path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    @cached_property
    def first(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def second(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.piece_path)

    @cached_property
    def first_bytes(self) -> list[bytes]:
        found = [b""] * (max(self.ranks.values()) + 1)
        for part, i in self.ranks.items():
            found[i] = part
        return found

    @cached_property
    def second_bytes(self) -> list[bytes]:
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()
                for p in pieces]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.fromiter(map(len, t), np.int64, len(t)) for t in (self.first_bytes, self.second_bytes))

    @cached_property
    def written(self) -> np.ndarray:
        """Decimal ids followed by a sign, [sign, id]: ',' within a side, '|' after the first, ';' after the second, none at the end."""
        n = max(map(len, self.lengths))
        return np.array([[f"{i}{sign}" for i in range(n)] for sign in (",", "|", ";", "")], dtype=object)

    def encode(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids of both sides; none for a text whose joined bytes differ from space + text on a side."""
        a_ids, b_ids = [], []
        for text, b in zip(texts, self.second.encode([t or "" for t in texts], num_threads=1), strict=True):
            a = self.first.encode_ordinary(" " + text) if text else []
            if text:
                whole = b" " + text.encode()
                if (b"".join(map(self.first_bytes.__getitem__, a)) != whole
                        or b"".join(map(self.second_bytes.__getitem__, b)) != whole):
                    a, b = [], []
            a_ids.append(a)
            b_ids.append(b if text else [])
        return a_ids, b_ids


def tokenizers(ranks_path: str, piece_path: str) -> Tokenizers:
    """One pair per Python worker."""
    return _state.setdefault((ranks_path, piece_path), Tokenizers(ranks_path, piece_path))


def coalesce(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of both sides, from their byte lengths over the same bytes."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    starts = np.concatenate([a_ends - a_lengths, b_ends - b_lengths])
    ends = np.concatenate([a_ends, b_ends])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    new = np.ones(len(order), bool)
    new[1:] = starts[order][1:] >= reached[:-1]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(new) - 1
    return groups[:len(a_lengths)], groups[len(a_lengths):]


def _distinct(group: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times), each id once in groups of many links, so links grow with distinct ids there."""
    dense = size[group] > DENSE
    if not dense.any():
        return group, ids, np.ones(len(ids), np.int64)
    keys, times = np.unique((group[dense] << 32) | ids[dense], return_counts=True)
    group = np.concatenate([group[~dense], keys >> 32])
    ids = np.concatenate([ids[~dense], keys & 0xFFFFFFFF])
    times = np.concatenate([np.ones(int((~dense).sum()), np.int64), times])
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], times[order]


def linked(doc_of_group, a_group, a_ids, b_group, b_ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, links) of every pair of ids that a document holds linked, sorted."""
    n = len(doc_of_group)
    size = np.bincount(a_group, minlength=n) * np.bincount(b_group, minlength=n)
    ga, a, ta = _distinct(a_group, a_ids, size)
    gb, b, tb = _distinct(b_group, b_ids, size)
    wide = np.bincount(gb, minlength=n)
    begin = np.cumsum(wide) - wide
    each = wide[ga]                       # links of every token of the first side
    done = np.cumsum(each)
    parts, low = [], 0
    while low < len(ga):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + LINKS_AT_ONCE, "right")))
        here = each[low:high]
        left = np.repeat(np.arange(low, high), here)
        right = begin[ga[left]] + np.arange(len(left)) - np.repeat(np.cumsum(here) - here, here)
        parts.append(_summed(doc_of_group[ga[left]], (a[left] << B_BITS) | b[right], ta[left] * tb[right]))
        low = high
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return parts[0] if len(parts) == 1 else _summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))


def _summed(doc, pair, times):
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]))
    return doc[first], pair[first], np.add.reduceat(times[order], first)


def _block(tok: Tokenizers, number: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    a_lists, b_lists = tok.encode(texts)
    n = len(texts)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a_lists, b_lists))
    a, b = (np.concatenate([np.asarray(x, np.int64) for x in lists]) for lists in (a_lists, b_lists))
    del a_lists, b_lists
    a_group, b_group = coalesce(tok.lengths[0][a], tok.lengths[1][b])
    doc_a = np.repeat(np.arange(n), n_a)
    doc_b = np.repeat(np.arange(n), n_b)
    # both sides cover the same bytes of every document, so no group crosses documents
    doc_of_group = np.zeros(int(a_group[-1]) + 1 if len(a_group) else 0, np.int64)
    doc_of_group[a_group] = doc_a
    n_groups = np.bincount(doc_of_group, minlength=n)
    size = np.bincount(a_group, minlength=len(doc_of_group)) * np.bincount(b_group, minlength=len(doc_of_group))
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, doc_of_group, size)

    # the written groups: tokens by group and side, each followed by the sign its place asks for
    group, side = np.concatenate([a_group, b_group]), np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(2 * group + side, kind="stable")
    part = (2 * group + side)[order]
    doc = np.concatenate([doc_a, doc_b])[order]
    sign = np.zeros(len(order), np.int64)
    if len(order):
        last = np.append(part[1:] != part[:-1], True)
        sign[last] = 1 + side[order][last]
        sign[np.append(doc[1:] != doc[:-1], True)] = 3
    written = tok.written[sign, np.concatenate([a, b])[order]]
    ends = np.cumsum(n_a + n_b)
    shas = [hashlib.sha256("".join(written[e - m:e].tolist()).encode()).hexdigest() if m else ""
            for e, m in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]

    doc, pair, times = linked(doc_of_group, a_group, a, b_group, b)
    pairs, places, holders = np.unique(pair, return_inverse=True, return_counts=True)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    one = lambda x, t: pa.array([x if isinstance(x, list) else x.tolist()], pa.list_(t))
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), one(ids.to_pylist(), pa.int64()),
        *[one(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)], one(shas, pa.string()),
        binary([bounds.astype("<u4").tobytes()]), binary([places.astype("<u4").tobytes()]), binary([times.astype("<u4").tobytes()]),
        one(pairs, pa.int64()), one(holders, pa.int32()),
    ], names=[f.split()[0] for f in BLOCKS.split(", ")])


def align(docs: DataFrame, ranks_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    ``n_best`` counts the links whose pair is held by as many documents as any pair of its first id,
    ``count_sum`` sums the pairs' numbers of documents over all links.  Null, empty and unlike texts have
    zeros and an empty digest.  Every row is a document, also with a null or repeated id; an empty table
    gives no row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, number = tokenizers(ranks_path, piece_path), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", block_bytes):
                yield _block(tok, number, column(batch, "doc_id"), column(batch, "text").to_pylist())
                number += 1

    blocks = settled(rows.mapInArrow(run, BLOCKS), "aligned-blocks")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    # at most one row per block and pair is sent, whatever the number of documents that hold it
    counts = settled(held.groupBy("pair").agg(F.sum("holders").alias("count")), "aligned-pairs")
    # one row per id of the first tokenizer: bounded by its vocabulary
    best = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("count").alias("most"))
    known = counts.withColumn("a", F.shiftright("pair", B_BITS)).join(F.broadcast(best), "a").select(
        "pair", F.when(F.col("count") == F.col("most"), -F.col("count")).otherwise(F.col("count")).alias("signed"))
    back = held.join(known, "pair").groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "signed"))), lambda s: s["signed"]).alias("signed"))
    wide = blocks.drop("pairs", "holders").join(back, "block", "left")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = lambda c: column(batch, c)[r]  # noqa: E731, B023
                bounds, places, times = (np.frombuffer(row(c).as_py(), "<u4").astype(np.int64) for c in ("bounds", "places", "times"))
                signed = row("signed").values
                signed = np.zeros(0, np.int64) if signed is None else signed.to_numpy()
                counts_here = signed[places]
                total = np.concatenate([[0], np.cumsum(np.abs(counts_here) * times)])
                best_here = np.concatenate([[0], np.cumsum((counts_here < 0) * times)])
                yield pa.RecordBatch.from_arrays([
                    row("doc_ids").values, *[row(c).values for c in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array(best_here[bounds[1:]] - best_here[bounds[:-1]]), pa.array(total[bounds[1:]] - total[bounds[:-1]]),
                    row("shas").values], names=[f.split()[0] for f in ALIGNED.split(", ")])

    return wide.mapInArrow(sums, ALIGNED)
