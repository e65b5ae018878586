"""Bags of n-grams that are never written out: blocks of texts, counted again in every pass.

A text is a fraction of the size of its exploded terms.  The tokens of the documents are dealt into blocks once
and kept; a pass counts a block's n-grams with numpy and leaves only sums.  A term's statistics reach a block as
one row per (block, distinct term), numbered by the block itself, so no row per (document, term) ever moves.

Distinct n-grams of a block are numbered in their sorted order, which depends on the block's texts alone: the
numbers are the same in every pass.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..plans.lookup import lookup
from ..plans.staging import keep, shuffle_width, stored

# The counting travels with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of tokens in a block: what one task holds, with some ten times that in numbers.
BLOCK_CHARS = 16_000_000
#: Bits of the hash that tells rare n-grams before any is sent by name; two that share one are told apart by name later.
RARE_BITS = 36


class Counted:
    """The bags of a block: ``doc``, ``col`` and ``tf`` of every (document, n-gram)."""

    def __init__(self, table: pa.Table, keys: Sequence[str], ngram_range: tuple[int, int]):
        rows = list(zip(*[table.column(c).to_pylist() for c in keys]))
        numbers: dict[tuple, int] = {}
        doc_of_row = np.array([numbers.setdefault(r, len(numbers)) for r in rows], np.int64)
        self.docs, self.n_docs = list(numbers), len(numbers)
        tokens = table.column("tokens").combine_chunks()
        lists = pc.split_pattern(tokens.cast(pa.large_string()), " ")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.words, n_words = coded.dictionary.take(pa.array(order)), len(order)
        rank = np.empty(n_words, np.int64)
        rank[order] = np.arange(n_words)
        ids = rank[coded.indices.to_numpy().astype(np.int64)] if n_words else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))   # tokens from here to the end of the row
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []             # per length: (prefix number, last word)
        doc, col, tf, offset, shape = [], [], [], 0, ids
        self.offsets = []
        for n in range(1, ngram_range[1] + 1):
            if n > 1:
                at = np.flatnonzero(left >= n)
                distinct, inverse = np.unique(shape[at] * n_words + ids[at + n - 1], return_inverse=True)
                shape = np.zeros(len(ids), np.int64)
                shape[at] = inverse
                self.levels.append((distinct // max(n_words, 1), distinct % max(n_words, 1)))
                size = len(distinct)
            else:
                at, size = np.arange(len(ids)), n_words
                self.levels.append((np.arange(n_words), np.arange(n_words)))
            self.offsets.append(offset if n >= ngram_range[0] else None)
            if n < ngram_range[0]:
                continue
            cells, counts = np.unique(doc_of_row[row[at]] * max(size, 1) + shape[at], return_counts=True)
            doc.append(cells // max(size, 1))
            col.append(cells % max(size, 1) + offset)
            tf.append(counts)
            offset += size
        self.doc, self.col, self.tf = (np.concatenate(x) for x in (doc, col, tf))
        self.n_cols = offset
        self.local = 1.0 + np.log(self.tf.astype(float))

    def names(self, cols: np.ndarray) -> pa.Array:
        """The n-grams of sorted numbers."""
        parts = []
        bounds = [o for o in self.offsets if o is not None] + [self.n_cols]
        for n, offset in enumerate(self.offsets):
            if offset is not None:
                end = bounds[bounds.index(offset) + 1] if offset in bounds else self.n_cols
                parts.append(self._named(n, cols[(cols >= offset) & (cols < end)] - offset))
        return pa.concat_arrays(parts)

    def _named(self, level: int, at: np.ndarray) -> pa.Array:
        prefix, last = self.levels[level]
        words = self.words.take(pa.array(last[at]))
        return words if level == 0 else pc.binary_join_element_wise(self._named(level - 1, prefix[at]), words, pa.scalar(" ", words.type))

    def known(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, place in ``cols``, local weight) of the n-grams numbered in ``cols``."""
        place = np.full(self.n_cols, -1, np.int64)
        place[cols] = np.arange(len(cols))
        at = place[self.col]
        held = at >= 0
        return self.doc[held], at[held], self.local[held]

    def hashes(self) -> np.ndarray:
        """``RARE_BITS`` bits per number, the same for an n-gram in every block."""
        words = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in self.words.to_pylist()], np.uint64)
        out, shape = [], words
        for n, (prefix, last) in enumerate(self.levels):
            if n:
                shape = shape[prefix] * np.uint64(0x9E3779B97F4A7C15) + (words[last] ^ (words[last] >> np.uint64(29)))
                shape = (shape ^ (shape >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            if self.offsets[n] is not None:
                out.append(shape)
        return np.concatenate(out) >> np.uint64(64 - RARE_BITS)

    def by_id(self) -> tuple[np.ndarray, list]:
        """(number of its doc_id for every document, the distinct ids)."""
        numbers: dict = {}
        return np.array([numbers.setdefault(d[0], len(numbers)) for d in self.docs], np.int64), list(numbers)


def _by_hash(hashes: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in the order of their hashes, the part of the hash range each falls into)."""
    order = np.argsort(hashes, kind="stable")
    return order, (hashes[order].astype(float) * (n_parts / 2.0**RARE_BITS)).astype(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by the place of their bytes: the upper ones, all zero, vanish when the exchange is compressed."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """One key for each of ``n`` partitions of a hash exchange, so that no two blocks share a task."""
    part = F.pmod(F.hash("id"), F.lit(n))
    rows = spark.range(n * 40).groupBy(part.alias("p")).agg(F.min("id").alias("id")).collect()  # at most n rows
    found = {r.p: r.id for r in rows}
    return [found.get(p, n * 40 + p) for p in range(n)]


class TextBags:
    """Bags of (doc_id, *carry) over the ``text`` of ``docs``; with a ``fold`` among ``carry`` a block holds one fold."""

    def __init__(self, docs: DataFrame, carry: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 2), text: str = "text"):
        self.keys, self.ngram_range = ["doc_id", *carry], tuple(ngram_range)
        self.folded = "fold" in carry
        tokens = F.array_join(tx.vector_terms(F.col(text)), " ")
        sizes = docs.groupBy("fold") if self.folded else docs.groupBy()
        chars = sizes.agg(F.sum(F.length(text)).alias("n")).collect()      # a row per fold
        width = shuffle_width(docs)
        total = sum(r.n or 0 for r in chars)
        per_fold = [(r["fold"] if self.folded else None, max(1, -(-(r.n or 0) // BLOCK_CHARS), round(width * (r.n or 0) / max(total, 1)))) for r in chars]
        spark = docs.sparkSession
        self.n_blocks = sum(n for _, n in per_fold)
        keys, block, first = _even_keys(spark, self.n_blocks), F.lit(None).cast("bigint"), 0
        for fold, n in per_fold:
            mine = F.get(F.array(*[F.lit(k).cast("bigint") for k in keys[first:first + n]]), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
            block = F.when(F.col("fold").eqNullSafe(F.lit(fold)), mine).otherwise(block) if self.folded else mine
            first += n
        rows = docs.select(block.alias("block"), *self.keys, F.nullif(tokens, F.lit("")).alias("tokens"))
        self.rows = keep(rows.repartition(self.n_blocks, "block"))

    def _counting(self) -> Callable[[pa.Table], Counted]:
        keys, ngram_range = self.keys, self.ngram_range
        return lambda table: Counted(table, keys, ngram_range)

    def pairs(self, min_df: int = 1) -> DataFrame:
        """(term, block, col, fold, n): the documents of a block that hold a term; below ``min_df`` in all most terms are left out."""
        count, folded = self._counting(), self.folded

        def emit(bags: Counted, table: pa.Table, cols: np.ndarray) -> pa.Table:
            n = np.bincount(bags.col, minlength=bags.n_cols)
            fold = table.column("fold")[0].as_py() if folded else None
            return pa.table({
                "term": bags.names(cols).cast(pa.string()), "block": pa.array(np.full(len(cols), table.column("block")[0].as_py())),
                "col": pa.array(cols.astype(np.int32)), "fold": pa.array([fold] * len(cols), pa.int32()),
                "n": pa.array(n[cols].astype(np.int32))})

        def run(table: pa.Table) -> pa.Table:
            bags = count(table)
            return emit(bags, table, np.arange(bags.n_cols))

        def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
            bags = count(left)
            order, part = _by_hash(bags.hashes(), n_parts)
            bits = {p: m for p, m in zip(right.column("part").to_pylist(), right.column("often").to_pylist())}
            often = [np.unpackbits(np.frombuffer(bits[p], np.uint8), count=int((part == p).sum())) for p in np.unique(part).tolist()]
            return emit(bags, left, np.sort(order[np.concatenate(often).astype(bool)]) if often else np.zeros(0, np.int64))

        schema = "term string, block bigint, col int, fold int, n int"
        if min_df <= 1:
            return self.rows.groupBy("block").applyInArrow(run, schema)
        n_parts = self.n_blocks
        return self.rows.groupBy("block").cogroup(self._often(min_df).groupBy("block")).applyInArrow(chosen, schema)

    def _often(self, min_df: int) -> DataFrame:
        """(block, part, often): a bit per n-gram of a block, in the order of the hashes: do ``min_df`` documents hold its hash?

        Hashes and counts travel as differences, some three bytes an n-gram; what shares a hash with others only
        looks more frequent than it is.
        """
        count, n_parts = self._counting(), self.n_blocks

        def hashed(table: pa.Table) -> pa.Table:
            bags = count(table)
            hashes = bags.hashes()
            order, part = _by_hash(hashes, n_parts)
            n = np.minimum(np.bincount(bags.col, minlength=bags.n_cols), min_df)[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            cuts = list(zip(first, [*first[1:], len(part)]))
            block = table.column("block")[0].as_py()
            return pa.table({
                "part": pa.array(part[first].astype(np.int32)), "block": pa.array(np.full(len(first), block)),
                "hashes": pa.array([_planes(np.diff(hashes[order[i:j]], prepend=np.uint64(0))) for i, j in cuts], pa.binary()),
                "n": pa.array([_planes(n[i:j].astype(np.uint64)) for i, j in cuts], pa.binary())})

        def often(table: pa.Table) -> pa.Table:
            hashes = [np.cumsum(_numbers(x), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
            n = np.concatenate([_numbers(x) for x in table.column("n").to_pylist()]).astype(float)
            _, place = np.unique(np.concatenate(hashes), return_inverse=True)
            enough = (np.bincount(place, n) >= min_df)[place]
            ends = np.cumsum([len(h) for h in hashes])
            return pa.table({"block": table.column("block"), "part": table.column("part"),
                             "often": pa.array([np.packbits(x).tobytes() for x in np.split(enough, ends[:-1])], pa.binary())})

        sent = self.rows.groupBy("block").applyInArrow(hashed, "part int, block bigint, hashes binary, n binary")
        return sent.groupBy("part").applyInArrow(often, "block bigint, part int, often binary")

    def vocabulary(self, min_df: int, held_out: Sequence[int | None] = (None,)) -> DataFrame:
        """(term, df, dfs, blocks, cols): df per training set where one reaches ``min_df``, and the term's number in every block."""
        held = list(held_out)

        def emit(rows: pa.Table) -> pa.RecordBatch:
            term = rows.column("term").combine_chunks()
            begin = np.flatnonzero(np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]))
            n = rows.column("n").to_numpy().astype(np.int64)
            fold = pc.fill_null(rows.column("fold"), -1).to_numpy()
            df = np.add.reduceat(n, begin)
            dfs = np.stack([df if v is None else np.add.reduceat(np.where((fold != v) & (fold >= 0), n, 0), begin) for v in held], axis=1)
            chosen = dfs.max(axis=1) >= min_df
            lengths = np.diff(np.append(begin, len(n)))
            inside = pa.array(np.repeat(chosen, lengths))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths[chosen])]).astype(np.int32))
            sets = pa.array((np.arange(chosen.sum() + 1) * len(held)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks().filter(inside)) for c in ("block", "col")]
            return pa.RecordBatch.from_arrays(
                [term.take(pa.array(begin[chosen])), pa.array(df[chosen]),
                 pa.ListArray.from_arrays(sets, pa.array(dfs[chosen].ravel().astype(np.int64))), *lists],
                names=["term", "df", "dfs", "blocks", "cols"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a term has at most one row per block: what is carried from batch to batch is small
            rest = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = pa.Table.from_batches([batch])
                rows = rows if rest is None else pa.concat_tables([rest, rows])
                term = rows.column("term").combine_chunks()
                new = np.flatnonzero(pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield emit(rows.slice(0, cut))
                rest = rows.slice(cut)
            if rest is not None and rest.num_rows:
                yield emit(rest)

        sorted_pairs = self.pairs(min_df).repartition(self.n_blocks, "term").sortWithinPartitions("term")
        return stored(sorted_pairs.mapInArrow(
            run, "term string, df bigint, dfs array<bigint>, blocks array<bigint>, cols array<int>"))

    def places(self, table: DataFrame, n_terms: int, values: Sequence[str], bytes_per_row: int, limit_bytes: int | None = None) -> DataFrame:
        """(block, col, *values) of the terms of ``table``: by its own places, or looked up by the blocks' terms."""
        if "blocks" in table.columns:
            return table.select(F.inline(F.arrays_zip("blocks", "cols")), *values).withColumnsRenamed({"blocks": "block", "cols": "col"})
        slim = table.select("term", "df", *values)
        return lookup(self.pairs().select("term", "block", "col"), slim, "term", n_terms, bytes_per_row=bytes_per_row,
                      frequency=F.col("df"), limit_bytes=limit_bytes).select("block", "col", *values)

    def visit(self, places: DataFrame, run: Callable[[Counted, np.ndarray, pa.Table, object], pa.Table], schema: str) -> DataFrame:
        """``run(bags, numbers, their rows, fold)`` for every block; the rows are sorted by number."""
        count, folded = self._counting(), self.folded

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            bags = count(left) if left.num_rows else None
            if bags is None:
                raise ValueError("a term is placed in a block without documents")
            right = right.sort_by("col")
            return run(bags, right.column("col").to_numpy().astype(np.int64), right, left.column("fold")[0].as_py() if folded else None)

        return self.rows.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(both, schema)


def matrix(rows: pa.Table, name: str, width: int) -> np.ndarray:
    """[row, entry] of an array column without nulls."""
    column = rows.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def idf_of(dfs: np.ndarray, n_docs: Sequence[int], min_df: int) -> np.ndarray:
    """Inverse document frequency per training set, 0 where a term is not in its vocabulary."""
    return np.where(dfs >= min_df, np.log((1.0 + np.asarray(n_docs, float)) / (1.0 + dfs)) + 1.0, 0.0)


def norms(bags: Counted, doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[document]: the norm of all weights under a document's id."""
    ids, distinct = bags.by_id()
    return np.sqrt(np.bincount(ids[doc], weights * weights, len(distinct)).astype(float))[ids]


def sum_terms(n_docs: Sequence[int], held: Sequence[int | None], min_df: int, label_at: int):
    """(term, label_idx, s): per training set the sums of a term's unweighted shares, for ``visit``."""

    def run(bags: Counted, cols: np.ndarray, rows: pa.Table, fold) -> pa.Table:
        idf = idf_of(matrix(rows, "dfs", len(held)), n_docs, min_df)
        doc, at, local = bags.known(cols)
        labels = [d[label_at] for d in bags.docs]
        label = np.array([-1 if x is None or d[0] is None else x for x, d in zip(labels, bags.docs)], np.int64)
        use = label[doc] >= 0
        n = len(cols)
        width = int(label.max(initial=-1)) + 1
        cell = label[doc] * n + at
        out, seen = np.zeros((width * n, len(held))), np.zeros(width * n, bool)
        seen[cell[use]] = True
        for i, v in enumerate(held):
            if v is not None and fold == v:
                continue
            norm = norms(bags, doc, local * idf[at, i])
            good = use & (norm[doc] > 0)
            out[:, i] = np.bincount(cell[good], local[good] / norm[doc[good]], width * n)
        held_cells = np.flatnonzero(seen)
        return pa.table({
            "term": bags.names(cols).cast(pa.string()).take(pa.array(held_cells % max(n, 1))),
            "label_idx": pa.array((held_cells // max(n, 1)).astype(np.int32)),
            "s": pa.ListArray.from_arrays(pa.array((np.arange(len(held_cells) + 1) * len(held)).astype(np.int32)), pa.array(out[held_cells].ravel()))})

    return run


def candidate_values(n_docs: Sequence[int], held: Sequence[int | None], min_df: int):
    """(term, v, value): the weights of the terms whose rows name training sets ``vs``, for ``visit``."""

    def run(bags: Counted, cols: np.ndarray, rows: pa.Table, fold) -> pa.Table:
        idf = idf_of(matrix(rows, "dfs", len(held)), n_docs, min_df)
        vs = rows.column("vs").to_pylist()
        doc, at, local = bags.known(cols)
        names = bags.names(cols).cast(pa.string())
        alive = np.array([d[0] is not None for d in bags.docs], bool)
        parts = []
        for i, v in enumerate(held):
            wanted = np.array([x is not None and i in x for x in vs], bool)
            if (v is not None and fold == v) or not wanted.any():
                continue
            x = local * idf[at, i]
            norm = norms(bags, doc, x)
            here = wanted[at] & alive[doc]
            parts.append((at[here], np.full(here.sum(), i, np.int32), x[here] / norm[doc[here]]))
        place, v, value = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
        return pa.table({"term": names.take(pa.array(place)), "v": pa.array(v.astype(np.int32)), "value": pa.array(value)})

    return run


def score_sums(n_classes: int, kind: pa.DataType):
    """(doc_id, norm, s): per document the norm and the sums over weight times ``lp`` per class, for ``visit``."""

    def run(bags: Counted, cols: np.ndarray, rows: pa.Table, fold) -> pa.Table:
        idf, lp = rows.column("idf").to_numpy(), matrix(rows, "lp", n_classes)
        ids, distinct = bags.by_id()
        doc, at, local = bags.known(cols)
        x = local * idf[at]
        norm = np.sqrt(np.bincount(ids[doc], x * x, len(distinct)).astype(float))
        sums = np.stack([np.bincount(ids[doc], x * lp[at, c], len(distinct)) for c in range(n_classes)], axis=1).astype(float)
        have = np.bincount(ids[doc], minlength=len(distinct)) > 0
        return pa.table({
            "doc_id": pa.array(distinct, kind).filter(pa.array(have)), "norm": pa.array(norm[have]),
            "s": pa.ListArray.from_arrays(pa.array((np.arange(have.sum() + 1) * n_classes).astype(np.int32)), pa.array(sums[have].ravel()))})

    return run


def weigh_terms(keys: Sequence[str], kinds: Sequence[pa.DataType]):
    """(doc_id, *carry, term, w): L2-normalised weights, for ``visit``."""

    def run(bags: Counted, cols: np.ndarray, rows: pa.Table, fold) -> pa.Table:
        idf = rows.column("idf").to_numpy()
        doc, at, local = bags.known(cols)
        x = local * idf[at]
        norm = norms(bags, doc, x)
        out = {}
        for i, (name, kind) in enumerate(zip(keys, kinds)):
            out[name] = pa.array([d[i] for d in bags.docs], kind).take(pa.array(doc))
        return pa.table({**out, "term": bags.names(cols).cast(pa.string()).take(pa.array(at)), "w": pa.array(x / norm[doc])})

    return run
