"""BPE codec, packing and token counts against the tokenizer libraries."""

import base64
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers_llm import texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressmark.llm import bpe_codec, packing, queries, token_counts
from pressmark.llm.queries import BYTE_RANKS, MULTI_RANKS, WORD_BPE
from pressmark.llm.word_bpe import WordEncoder


def reference(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("window,overlap", [(bpe_codec.WINDOW, bpe_codec.OVERLAP), (400, 40), (64, 8)])
def test_ids_equal_the_library_and_decode_to_the_bytes(odd, small, window, overlap):
    enc = reference(MULTI_RANKS)
    for docs in (odd, small.limit(40)):
        encoded = bpe_codec.encode(docs, MULTI_RANKS, window, overlap)
        got = Counter((r["doc_id"], bytes(r["ids"]), r["n_tokens"], bytes(r["decoded"]))
                      for r in bpe_codec.decode(encoded, MULTI_RANKS).collect())
        want = Counter()
        for i, t in texts(docs):
            ids = enc.encode_ordinary(t or "")
            want[(i, np.array(ids, "<u4").tobytes(), len(ids), (t or "").encode())] += 1
        assert got == want


def test_windows_without_a_common_boundary_are_joined():
    enc = bpe_codec.Encoder(MULTI_RANKS)
    for text in ("a" * 300, " " * 300 + "b", "ab " * 10 + "c" * 200 + " d e" * 50, "\n" * 99 + "x", "1" * 130 + "a" * 70):
        window, overlap = 50, 10
        rows = []
        for w in range(-(-len(text) // window)):
            part = text[w * window:w * window + window + overlap]
            rows.append((w, part, *[np.asarray(x, "<u4").tobytes() for x in enc.window(part)]))
        group = pd.DataFrame(rows, columns=["w", "part", "starts", "counts", "ids"])
        assert bpe_codec.stitch(group, enc, window) == enc.encoding.encode_ordinary(text)


def test_an_overlap_must_fit(odd):
    with pytest.raises(ValueError):
        bpe_codec.encode(odd, MULTI_RANKS, 10, 10)


def test_the_word_cache_stays_small():
    enc = WordEncoder(WORD_BPE)
    distinct = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(26**4)]
    lots = [pa.array([" ".join(distinct[i:i + 20_000])]) for i in range(0, len(distinct), 20_000)]
    found = [enc.batch(lot) for lot in lots]
    assert len(enc.words) <= 240_000 and len(enc.pieces) <= 240_000 and packing.SLICE <= 2 << 20
    again = [enc.batch(lot) for lot in reversed(lots)][::-1]
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(found, again))
    probe = enc.batch(pa.array([" ".join(distinct[:50])]))[0].tolist()
    assert probe == Tokenizer.from_file(WORD_BPE).encode(" ".join(distinct[:50]), add_special_tokens=False).ids


def test_no_documents(empty):
    assert bpe_codec.decode(bpe_codec.encode(empty, MULTI_RANKS), MULTI_RANKS).count() == 0
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_word_ids_equal_the_library_for_every_character():
    full, enc = Tokenizer.from_file(WORD_BPE), WordEncoder(WORD_BPE)
    import pyarrow as pa

    characters = [chr(c) for c in [*range(1, 0x600), *range(0x1E00, 0x2100), *range(0x3000, 0x3100), *range(0xFB00, 0xFB50)]]
    made = [f"Ab{c}d {c}{c}9 x{c}" for c in characters] + ["<|endoftext|> a<|endoftext|>b", "I'Ll it's 'S x'", ""]
    ids, counts = enc.batch(pa.array([*made, None]))
    want = [e.ids for e in full.encode_batch([*made, ""], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_every_id_lies_in_one_piece(odd, small):
    full = Tokenizer.from_file(WORD_BPE)
    for docs, repeated in ((odd, True), (small, False)):
        rows = packing.pack(docs, WORD_BPE, with_ids=True).toPandas()
        used = rows.groupby("sequence_id")["length"].sum()
        assert used.max() <= 2048
        rows = rows.sort_values(["sequence_id", "offset"])
        assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
        assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(rows["ids"], rows["ids_crc32"], rows["length"]))
        want = Counter()
        for i, t in texts(docs):
            ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want.update((i, s, ids[s:s + 2048].tobytes(), len(ids)) for s in range(0, len(ids), 2048))
        got = Counter((None if pd.isna(r.doc_id) else r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in rows.itertuples())
        assert got == want


def test_padding_is_small(small):
    row = packing.padding(packing.pack(small, WORD_BPE)).iloc[0]
    assert row["padding"] <= 0.06 * row["ids"]


def test_patterns_cover_the_demand_and_come_close_to_the_bound():
    rng = np.random.default_rng(3)
    for capacity, demand in ((64, rng.integers(0, 400, 64)), (64, np.eye(64, dtype=int)[40] * 7), (16, np.zeros(16, int)),
                             (128, rng.integers(0, 3, 128))):
        plan = packing.patterns(demand.astype(np.int64))
        covered = sum((p * n for p, n in plan), np.zeros(capacity, np.int64))
        assert (covered == demand).all()
        assert all((p * np.arange(1, capacity + 1)).sum() <= capacity and n > 0 for p, n in plan)
    # sizes that combine freely, so the volume is the bound
    demand = np.where(np.arange(1, 65) <= 24, rng.integers(0, 4000, 64), 0)
    bound = (demand * np.arange(1, 65)).sum() / 64
    assert sum(n for _, n in packing.patterns(demand)) <= 1.01 * bound + 1


def test_the_dearest_pattern_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        values = np.round(rng.random(9), 2)
        best = np.zeros(10)
        for c in range(1, 10):
            best[c] = max([best[c - 1], *(values[s - 1] + best[c - s] for s in range(1, c + 1))])
        worth, pattern = packing.price(values, 9)
        assert worth == pytest.approx(best[9])
        assert (pattern * values).sum() == pytest.approx(worth) and (pattern * np.arange(1, 10)).sum() <= 9


def totals(ledger):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}


def test_the_ledger_equals_a_recount(spark, odd, small, tmp_path):
    versions = {"a": BYTE_RANKS, "b": MULTI_RANKS}
    encs = {"a": reference(BYTE_RANKS), "b": reference(MULTI_RANKS)}
    state = [(r["doc_id"], r["source"], r["lang"], r["text"]) for r in odd.unionByName(small, allowMissingColumns=True).collect()]

    def recount():
        out = defaultdict(lambda: [0, 0])
        for _, source, lang, text in state:
            for v, e in encs.items():
                out[(source, lang, v)][0] += 1
                out[(source, lang, v)][1] += len(e.encode_ordinary(text or ""))
        return {k: tuple(x) for k, x in out.items()}

    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert totals(ledger) == {} and ledger.committed() == []
    both = odd.select("doc_id", "text", "lang", "source").unionByName(small.select("doc_id", "text", "lang", "source"))
    assert ledger.commit("0", ledger.insertions(token_counts.count_tokens(both, versions)))
    assert totals(ledger) == recount()
    ids = spark.createDataFrame([(7,), (7,), (None,), (10**9,), (20,)], "doc_id bigint")
    state = [s for s in state if s[0] not in (7, 20)]
    gone = ledger.deletions(ids)
    assert ledger.commit("1", gone) and not ledger.commit("1", gone)
    assert totals(ledger) == recount()
    changed = small.where("doc_id between 30 and 60").withColumn("text", F.concat("text", F.lit(" more"))).withColumn("source", F.lit("new"))
    state = [s for s in state if not (s[0] and 30 <= s[0] <= 60)] + [
        (r["doc_id"], r["source"], r["lang"], r["text"]) for r in changed.collect()]
    assert ledger.commit("2", ledger.revisions(token_counts.count_tokens(changed, versions)))
    assert totals(ledger) == recount()
    assert not ledger.commit("2", ledger.insertions(token_counts.count_tokens(changed, versions)))
    assert totals(token_counts.Ledger(spark, str(tmp_path / "ledger"))) == recount()
    assert ledger.committed() == ["0", "1", "2"]


def test_texts_that_stay_are_kept_under_a_revised_id(spark, tmp_path):
    """Two texts under one poor id, only one of them with repeated lines: both are counted after the revision."""
    rows = [(1, "a b\na b", "s", "en"), (1, "other words", "t", "en"), (1, None, "u", "en"), (2, "stays", "s", "en"), (3, "x\nx", "s", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    enc = reference(BYTE_RANKS)
    size = lambda *found: (len(found), sum(len(enc.encode_ordinary(t)) for t in found))
    got = {r["source"]: (r["n_docs"], r["n_tokens"]) for r in queries.op2_token_counts(spark, str(tmp_path)).collect()
           if r["tokenizer"] == "byte_bpe_50k"}
    assert got == {"s": size("a b", "stays", "x\nx"), "t": size("other words"), "u": size("")}


def test_a_batch_left_half_written_is_written_anew(spark, small, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "l"))
    counts = token_counts.count_tokens(small, {"a": BYTE_RANKS})
    # rows without a rollup: not committed, so not counted
    ledger.insertions(counts).write.parquet(str(tmp_path / "l" / "signed" / "0"))
    assert totals(ledger) == {}
    assert ledger.commit("0", ledger.insertions(counts)) and sum(n for n, _ in totals(ledger).values()) == 200
    with pytest.raises(ValueError):
        ledger.commit("a/b", ledger.insertions(counts))


def test_an_empty_ledger_and_no_documents(spark, empty, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "l"))
    assert ledger.commit("0", ledger.insertions(token_counts.count_tokens(empty, {"a": BYTE_RANKS})))
    assert ledger.commit("1", ledger.deletions(empty.select("doc_id"))) and totals(ledger) == {}


def test_a_batch_built_on_an_older_state_is_refused(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "l"))
    docs = spark.createDataFrame([(1, "one two three", "en", "s"), (2, "four five", "en", "s")], "doc_id bigint, text string, lang string, source string")
    counts = token_counts.count_tokens(docs, {"a": BYTE_RANKS})
    ledger.commit("0", ledger.insertions(counts))
    one, two = ledger.deletions(docs.where("doc_id = 1")), ledger.deletions(docs.where("doc_id = 1"))
    late = ledger.revisions(token_counts.count_tokens(docs.where("doc_id = 2"), {"a": BYTE_RANKS}))
    assert ledger.commit("1", one)
    left = totals(ledger)
    assert [n for n, _ in left.values()] == [1]
    for name, batch in (("2", two), ("3", late)):
        with pytest.raises(token_counts.StaleBatch):
            ledger.commit(name, batch)
    assert totals(ledger) == left and ledger.committed() == ["0", "1"]
    assert ledger.commit("2", ledger.deletions(docs.where("doc_id = 1"))) and totals(ledger) == left
    assert not ledger.commit("1", two) and totals(ledger) == left
