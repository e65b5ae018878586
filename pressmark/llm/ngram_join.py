"""Jaccard self-join on word n-gram sets: candidates by rare n-grams, verified in prefix trees.

1. Texts with one n-gram set are one class; from here on a class stands for its texts.
2. Of every class the smallest n-grams (by hash) are looked at: enough of them that two classes that
   link share at least ``k`` of these (see ``looked_at``).  How many classes hold each is counted.
3. Of those the rarest remain, so many that two classes that link still share one.  N-grams of a single
   class need no partner and fall away; what a large part of the corpus has in common is looked at last.
   Classes that share a remaining n-gram belong to one cluster.
4. Clusters are cut into blocks; every pair of blocks is joined by one task: one block's sets, ordered
   by how common their n-grams are, form a prefix tree; the other block's sets walk it together, carry
   their partial overlaps down, and leave a subtree when the lengths left cannot reach the threshold.

All steps are exact: the order of n-grams decides cost, never results.  N-grams and classes are known
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, settled, slices
from .components import connected
from .wordtable import NOT_SPACE, gram_hashes, mix, words_of

GRAM = 5
PERCENT = 75
#: Sets up to this size are looked at whole.
WHOLE = 128
RANGE_TOKENS = 600_000
#: An n-gram held by more classes than this, and than this share of all n-grams, is common.
COMMON = 20_000
COMMON_SHARE = 1e-6
BLOCK_SETS = 600
BLOCK_TOKENS = 300_000
PROBES = 128
SLICE = 4 << 20


def needed(n, percent: int = PERCENT):
    """Fewest n-grams that a set of ``n`` shares with any set it links with."""
    return -(-n * percent // 100)


def shared(n, percent: int = PERCENT):
    """``k`` of the looked-at part; it never falls as ``n`` grows and is at most ``needed(n)``."""
    return np.where(n <= WHOLE, needed(n, percent), np.maximum(needed(WHOLE, percent), 1 + n // 10))


def looked_at(n, percent: int = PERCENT):
    """Size of the looked-at part: two linked sets share k = min(k of both) n-grams of these parts.

    The k-th common n-gram has at least needed(n) - k common ones behind it, so it lies among the first
    n - needed(n) + k.
    """
    return n - needed(n, percent) + shared(n, percent)


class Sets:
    """Distinct n-gram hashes, ascending, of a slice of texts, and what follows from them."""

    def __init__(self, texts: pa.Array, gram: int, percent: int):
        words = words_of(texts, NOT_SPACE)
        hashes, bounds = gram_hashes(words.hashes(), words.bounds, gram)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.n = np.bincount(self.owner, minlength=len(texts))
        self.begin = np.cumsum(self.n) - self.n
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes), dtype=np.uint64)])
        ends = self.begin + self.n
        self.cid = (mix(total[ends] - total[self.begin] + self.n.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        self.look = np.minimum(looked_at(self.n, percent), self.n)

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(looked-at n-grams, row) of the chosen rows."""
        size = self.look[rows]
        own = np.repeat(rows, size)
        at = np.repeat(self.begin[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.hashes[at], own


def _sets(batches, gram: int, percent: int, name: str = "text") -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for whole in batches:
        for batch in slices(whole, name, SLICE):
            yield batch, Sets(column(batch, name), gram, percent)


def _fresh(found: Sets, seen: set) -> np.ndarray:
    """Rows of classes this task has not met yet: copies add nothing."""
    rows = []
    for i, (cid, n) in enumerate(zip(found.cid.tolist(), found.n.tolist(), strict=True)):
        if n and cid not in seen:
            seen.add(cid)
            rows.append(i)
    return np.array(rows, np.int64)


def _blobs(key: str, keys: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row a key, with the key's values of every column as bytes."""
    order = keys.argsort(kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.concatenate([at[1:], [len(keys)]]) if len(keys) else at
    arrays, names = [pa.array(keys[at].astype(np.int32))], [key]
    for name, values in columns.items():
        data, size = memoryview(np.ascontiguousarray(values[order]).tobytes()), values.dtype.itemsize
        arrays.append(pa.array([data[a * size:b * size].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _joined(values: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


#: N-grams are compared by their leading 48 bits while candidates are sought: equal ones stay equal.
TOKEN = np.dtype([("low", "<u4"), ("high", "<u2")])


def _short(hashes: np.ndarray) -> np.ndarray:
    out = np.empty(len(hashes), TOKEN)
    out["high"] = (hashes >> np.uint64(48)).astype(np.uint16)
    out["low"] = ((hashes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def _token(short: np.ndarray) -> np.ndarray:
    return (short["high"].astype(np.uint64) << np.uint64(32)) | short["low"].astype(np.uint64)


def common_tokens(docs: DataFrame, total: int, gram: int, percent: int) -> np.ndarray:
    """N-grams (48 bits) held by very many classes, at most 1 / COMMON_SHARE of them.

    Counted are those that a slice of texts holds twice, over all slices; what this misses is only
    handled less cheaply.
    """
    least = max(COMMON, int(total * COMMON_SHARE))

    def run(batches):
        seen: set = set()
        for _, found in _sets(batches, gram, percent):
            hashes, _ = found.parts(_fresh(found, seen))
            values, counts = np.unique(hashes >> np.uint64(16), return_counts=True)
            often = counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[often].astype(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= least).select("token").collect()
    return np.sort(np.array([r["token"] for r in rows], np.uint64))


def clusters(docs: DataFrame, total: int, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(node, component) of classes that may link; ``total`` is the number of looked-at n-grams."""
    common = common_tokens(docs, total, gram, percent)
    ranges = max(8, -(-total // RANGE_TOKENS))

    def in_common(tokens: np.ndarray) -> np.ndarray:
        return np.isin(tokens, common) if len(common) else np.zeros(len(tokens), bool)

    def tokens(batches):
        seen: set = set()
        for _, found in _sets(batches, gram, percent):
            hashes, own = found.parts(_fresh(found, seen))
            held = ~in_common(hashes >> np.uint64(16))
            hashes, own = hashes[held], own[held]
            yield _blobs("part", ((hashes >> np.uint64(16)) % np.uint64(ranges)).astype(np.int64), tokens=_short(hashes), cids=found.cid[own])

    def records(batches):
        """For each class how many of its commonest looked-at n-grams are left out; and the common ones that are not."""
        seen: set = set()
        for _, found in _sets(batches, gram, percent):
            rows = _fresh(found, seen)
            hashes, own = found.parts(rows)
            often = in_common(hashes >> np.uint64(16))
            n_common = np.bincount(own[often], minlength=len(found.n))[rows] if len(rows) else rows
            # two linked sets share k n-grams of their parts, k as of the smallest possible partner
            k = shared(needed(found.n[rows], percent), percent)
            yield from [_records(found.cid[rows], np.maximum(0, k - 1 - n_common), None)]
            spare = n_common - k + 1
            if (spare > 0).any():
                place = dict(zip(rows.tolist(), spare.tolist(), strict=True))
                taken: dict[int, int] = {}
                a, b = [], []
                for i, token in zip(own[often].tolist(), (hashes[often] >> np.uint64(16)).tolist(), strict=True):
                    if taken.get(i, 0) < place[i]:
                        taken[i] = taken.get(i, 0) + 1
                        a.append(int(found.cid[i]))
                        # a common n-gram is a node of its own, below zero
                        b.append(-1 - token)
                yield _records(np.array(a, np.int64), None, np.array(b, np.int64))

    kept = settled(docs.select("text").mapInArrow(records, "cid bigint, left_out bigint, token bigint"), "records")

    def rare(group: pd.DataFrame) -> pd.DataFrame:
        """What several classes hold, with the number of classes, sorted into parts by class."""
        token, cid = _token(_joined(group["tokens"], TOKEN)), _joined(group["cids"], "<i8")
        order = np.lexsort((cid, token))
        token, cid = token[order], cid[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        token, cid = token[new], cid[new]
        _, at, counts = np.unique(token, return_inverse=True, return_counts=True)
        several = counts[at] > 1
        out = _blobs("part", cid[several] % ranges, tokens=token[several].astype("<u8"), cids=cid[several],
                     held=np.minimum(counts[at][several], 2**32 - 1).astype("<u4"))
        return out.to_pandas()

    answers = docs.select("text").mapInArrow(tokens, "part int, tokens binary, cids binary").groupBy("part").applyInPandas(
        rare, "part int, tokens binary, cids binary, held binary")

    def chosen(key, answer: pd.DataFrame, record: pd.DataFrame) -> pd.DataFrame:
        """The rarest n-grams of each class, sorted into parts by n-gram again."""
        token, cid, held = (_joined(answer[c], k) for c, k in (("tokens", "<u8"), ("cids", "<i8"), ("held", "<u4")))
        record = record.drop_duplicates("cid")
        order = np.lexsort((token, held, cid))
        token, cid = token[order], cid[order]
        ids, begin, counts = np.unique(cid, return_index=True, return_counts=True)
        out_of = pd.Series(record["left_out"].to_numpy(), index=record["cid"].to_numpy()).reindex(ids).to_numpy()
        take = np.repeat(counts - out_of, counts) > np.arange(len(cid)) - np.repeat(begin, counts)
        return _blobs("part", (token[take] % np.uint64(ranges)).astype(np.int64), tokens=token[take], cids=cid[take]).to_pandas()

    by_class = kept.where(F.col("left_out").isNotNull()).select(
        "cid", "left_out", F.pmod("cid", F.lit(ranges)).cast("int").alias("part"))
    selected = answers.groupBy("part").cogroup(by_class.groupBy("part")).applyInPandas(
        chosen, "part int, tokens binary, cids binary")

    def stars(group: pd.DataFrame) -> pd.DataFrame:
        token, cid = _joined(group["tokens"], "<u8"), _joined(group["cids"], "<i8")
        order = np.lexsort((cid, token))
        token, cid = token[order], cid[order]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        smallest = cid[np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))]
        pairs = np.unique(np.stack([smallest, cid], axis=1)[smallest != cid], axis=0)
        return pd.DataFrame(pairs, columns=["a", "b"])

    edges = selected.groupBy("part").applyInPandas(stars, "a bigint, b bigint")
    through = kept.where(F.col("token").isNotNull()).select(F.col("token").alias("a"), F.col("cid").alias("b"))
    return connected(edges.unionByName(through))


def _records(cid: np.ndarray, left_out, token) -> pa.RecordBatch:
    empty = pa.nulls(len(cid), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(cid, pa.int64()), empty if left_out is None else pa.array(left_out, pa.int64()),
         empty if token is None else pa.array(token, pa.int64())], names=["cid", "left_out", "token"])


class Tree:
    """A prefix tree over sets of ranks, implied by their sorted order."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent
        self.common = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m

    def walk(self, held: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(set, linked probes); ``held[rank, probe]`` tells the probes' members, ``n`` their sizes."""
        every = np.arange(len(n))
        todo = [(0, len(self.sets), 0, np.zeros(len(n), np.int64), every)]
        while todo:
            low, high, depth, overlap, active = todo.pop()
            end = int(self.common[low + 1:high].min()) if high - low > 1 else int(self.sizes[low])
            segment = self.sets[low][depth:end]
            if len(segment):
                rows = held[segment]
                overlap = overlap + (rows if len(active) == len(n) else rows[:, active]).sum(axis=0, dtype=np.int64)
            smallest, largest = int(self.sizes[low:high].min()), int(self.sizes[low:high].max())
            # (100 + percent) * overlap >= percent * (both sizes) is the threshold
            best = overlap + np.minimum(n[active] - overlap, largest - end)
            able = (100 + self.percent) * best >= self.percent * (n[active] + smallest)
            if not able.any():
                continue
            overlap, active = overlap[able], active[able]
            if high - low == 1:
                yield self.order[low], active
                continue
            # children differ in the next rank; a set that ends here comes first
            cuts = [low, *(low + 1 + np.flatnonzero(self.common[low + 1:high] <= end)).tolist(), high]
            todo.extend((a, b, end, overlap, active) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def join_blocks(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """(index in left, linked indices in right); both are lists of ascending arrays of hashes."""
    values, at, counts = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    # common n-grams first, so that similar sets share long paths
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ends = np.cumsum([len(s) for s in left + right])
    ranked = np.split(rank[at], ends[:-1])
    tree = Tree([np.sort(s) for s in ranked[:len(left)]], percent)
    width = 1 + max(int(s.max()) for s in tree.sets)
    out = []
    for begin in range(0, len(right), PROBES):
        probes = ranked[len(left) + begin:len(left) + begin + PROBES]
        held = np.zeros((width, len(probes)), np.uint8)
        for j, s in enumerate(probes):
            held[s[s < width], j] = 1
        n = np.array([len(s) for s in probes])
        out.extend((i, begin + linked) for i, linked in tree.walk(held, n))
    return out


def _linked(key, cids, weights, sides, sets, percent) -> tuple[list, list, list]:
    """Rows (a, b, links) of one pair of blocks: b null for counted links, links null for an edge."""
    same = key[1] == key[2]
    left = [i for i, s in enumerate(sides) if s == 0]
    right = left if same else [i for i, s in enumerate(sides) if s == 1]
    if not left or not right:
        return [], [], []
    links = np.zeros(len(cids), np.int64)
    label = np.arange(len(cids))
    right_index, weight = np.array(right), np.array(weights)
    for i, linked in join_blocks([sets[i] for i in left], [sets[i] for i in right], percent):
        i, linked = left[i], right_index[linked]
        if same:
            linked = linked[linked != i]
        if not len(linked):
            continue
        links[i] += weight[linked].sum()
        if not same:
            links[linked] += weight[i]
        joined = np.unique(np.concatenate([label[[i]], label[linked]]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    counted = np.flatnonzero(links)
    tied = np.flatnonzero(label != np.arange(len(cids)))
    a = [cids[i] for i in counted] + [cids[i] for i in tied]
    b = [None] * len(counted) + [cids[label[i]] for i in tied]
    return a, b, [int(x) for x in links[counted]] + [None] * len(tied)


def ngram_join(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, text_hash, component), one row for each row of ``docs`` (doc_id, text).

    Words are white-space-separated, with A-Z in lower case.  A text of fewer words than ``gram`` has its
    whole sequence as its only n-gram; without words it has none and links with nothing.  Two rows link
    when 100 * shared >= percent * united n-grams.  ``component_id`` is the smallest doc_id reachable.
    Repeated rows and rows with one doc_id count one by one.  A row with a null doc_id links and is
    counted, but gives no component its id; its own is null if no other can be reached.  ``component`` tells
    components apart that share a smallest id (null without words).  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def member(batches):
        for batch, found in _sets(batches, gram, percent):
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text_hash"), pa.array(found.n.astype(np.int64)), pa.array(found.cid),
                 pa.array(found.look.astype(np.int64))], names=["doc_id", "text_hash", "n", "cid", "look"])

    members = settled(rows.mapInArrow(member, "doc_id bigint, text_hash bigint, n bigint, cid bigint, look bigint"), "members")
    classes = settled(members.where("n > 0").groupBy("cid").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("look").alias("look")), "classes")
    total = classes.agg(F.sum("look")).first()[0] or 0
    found = clusters(rows, total, gram, percent).where("node >= 0")
    candidates = settled(classes.join(found.withColumnRenamed("node", "cid"), "cid"), "candidates")
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).where("sets > 1")
    blocks = sizes.select("component", F.greatest(
        F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = candidates.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    # one text stands for its class; the candidates' number has no bound, so they are never broadcast
    chosen = placed.select(
        F.col("row.doc_id").alias("row_id"), F.col("row.text_hash").alias("row_hash"), "cid", "component", "copies", "blocks", "block")
    texts = rows.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("text_hash") == F.col("row_hash")))
    schema = "component bigint, cid bigint, copies bigint, blocks int, block int, grams binary"

    def own_sets(batches):
        seen: set = set()
        for batch, sets in _sets(batches, gram, percent):
            # rows repeated in full say the same once more
            own = _fresh(sets, seen)
            yield pa.RecordBatch.from_arrays(
                [column(batch, c).take(pa.array(own)) for c in ("component", "cid", "copies", "blocks", "block")]
                + [pa.array([sets.hashes[sets.begin[i]:sets.begin[i] + sets.n[i]].tobytes() for i in own.tolist()], pa.binary())],
                names=["component", "cid", "copies", "blocks", "block", "grams"])

    each = texts.select("text", "component", "cid", "copies", "blocks", "block").mapInArrow(own_sets, schema)
    # every block meets every block of its cluster once
    pairs = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "cid", "copies", "grams")
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism,
                int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "cid")

    def verify(batches):
        key, held = None, ([], [], [], [])

        def done():
            a, b, links = _linked(key, *held, percent)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            columns = [column(batch, c).to_pylist() for c in ("component", "i", "j", "cid", "copies", "side")]
            for row, blob in zip(zip(*columns, strict=True), column(batch, "grams"), strict=True):
                if row[:3] != key:
                    if key is not None:
                        yield done()
                    key, held = row[:3], ([], [], [], [])
                # repeated rows bring a class more than once
                if held[0] and held[0][-1] == row[3]:
                    continue
                for values, value in zip(held, (row[3], row[4], row[5], np.frombuffer(blob.as_py(), np.uint64)), strict=True):
                    values.append(value)
        if key is not None:
            yield done()

    verified = settled(dealt.mapInArrow(verify, "a bigint, b bigint, links bigint"), "links")
    links = verified.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    joined = connected(verified.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    labelled = classes.join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = labelled.join(smallest, "component").join(links, "cid", "left").select(
        "cid", "component", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = F.when(F.col("n") > 0, F.col("cid"))
    return members.withColumn("cid", own).join(per_class, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash", F.when(F.col("n") > 0, F.col("component")).alias("component"))
