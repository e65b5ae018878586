"""Aligned tokens against a plain walk over the bytes, with the ids of the vocabulary files' own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers_llm import texts
from tokenizers import Tokenizer

from pressmark.llm import alignment
from pressmark.llm.queries import BYTE_RANKS, PIECE_BPE


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def tokens(text, libraries):
    """[(id, bytes)] of both sides, or none."""
    first, second = libraries
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    if not text:
        return [], []
    got = first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letter[c] for c in t)) for i, t in zip(got.ids, got.tokens, strict=True)]
    b = []
    for i in second.encode(text):
        p = second.id_to_piece(i)
        b.append((i, bytes.fromhex(p[3:5]) if second.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])


def groups_of(a, b):
    groups, i, j = [], 0, 0
    while i < len(a):
        left, right, x, y = [], [], 0, 0
        while not left or x != y:
            if x <= y and i < len(a) and (x < y or not left):
                left.append(a[i][0])
                x += len(a[i][1])
                i += 1
            else:
                right.append(b[j][0])
                y += len(b[j][1])
                j += 1
        groups.append((left, right))
    return groups


def brute(rows, libraries):
    found = [(i, *tokens(t, libraries)) for i, t in rows]
    found = [(i, a, b, groups_of(a, b)) for i, a, b in found]
    counts = Counter()
    links = [Counter((x, y) for left, right in g for x in left for y in right) for *_, g in found]
    for held in links:
        counts.update(held.keys())
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return Counter(
        (i, len(a), len(b), len(g), sum(held.values()), sum(m for p, m in held.items() if counts[p] == most[p[0]]),
         sum(m * counts[p] for p, m in held.items()),
         hashlib.sha256(";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g).encode()).hexdigest()
         if g else "") for (i, a, b, g), held in zip(found, links, strict=True))


SIGNS = ["<|endoftext|> <s> </s> <unk> <0x41>", "▁ a▁b", "  two  spaces \n\n\t x", "\x1c\x1d\x85　  a​", "日本語 😀👩‍👩‍👧 é é",
         "a", " ", "\n", "İıſK ﬁ ǅ", "1234567890123 12.5e-7", "don't we'll 'S", "\x00\x01 ﻿ ￿ \U0010ffff", "ααα βββ" * 30, "=" * 500,
         "ab" * 700, "     ᠎ x", "ᄀᄁᄂ ก็ हिन्दी"]


def test_alignment_equals_the_walk(spark, odd, small, libraries):
    signs = spark.createDataFrame(list(enumerate(SIGNS)), "doc_id bigint, text string")
    for docs, size in ((odd.unionByName(signs, True), 4 << 20), (signs, 100), (small.limit(60), 20_000)):
        got = Counter(tuple(r) for r in alignment.align(docs, BYTE_RANKS, PIECE_BPE, size).collect())
        assert got == brute(texts(docs), libraries)


def test_dense_groups_are_reduced_without_losing_links(monkeypatch):
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    doc_of_group = np.array([0, 0, 1, 2])
    ga, gb = np.sort(rng.integers(0, 4, 60)), np.sort(rng.integers(0, 4, 50))
    a, b = rng.integers(0, 5, 60), rng.integers(0, 4, 50)
    want = Counter((doc_of_group[x], (i << alignment.B_BITS) | j) for x, i in zip(ga, a, strict=True) for y, j in zip(gb, b, strict=True) if x == y)
    doc, pair, times = alignment.linked(doc_of_group, ga, a, gb, b)
    assert dict(zip(zip(doc, pair, strict=True), times, strict=True)) == want


def test_no_documents(empty):
    assert alignment.align(empty, BYTE_RANKS, PIECE_BPE).collect() == []
