import math
import re
from collections import Counter

import pytest

from pressmark.operators import bayes, terms
from pressmark.operators import text_bags as tb
from pressmark.operators.text_bags import TextBags
from pressmark.plans import lookup as lk

ROWS = [(1, 0, "Aa bb aa bb cc"), (1, 0, "bb cc"), (2, 1, "aa"), (3, 1, ""), (4, 0, None), (None, 0, "aa cc"), (5, 1, "é_1 bb x cc dd"), (6, 1, "aa bb cc dd")]


def grams(text, high=2):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(" ".join(words[i:i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1))


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, label_idx int, text string")


@pytest.mark.parametrize("high", [2, 3])
def test_vocabulary_and_weights_equal_counting_by_hand(spark, monkeypatch, high):
    monkeypatch.setattr(tb, "RARE_BITS", 4)    # nearly every n-gram shares its hash with others
    docs, merged = {}, frame(spark)
    for d, y, text in ROWS:
        docs.setdefault((d, y), Counter()).update(grams(text, high))
    df = Counter(t for bag in docs.values() for t in bag)
    bags = TextBags(merged, ["label_idx"], (1, high))
    found = {r.term: (r.df, len(r.blocks)) for r in bags.vocabulary(2).collect()}
    assert {t: n for t, (n, _) in found.items()} == {t: n for t, n in df.items() if n >= 2}
    assert all(1 <= blocks <= n for n, blocks in found.values())
    model = terms.fit_tfidf(bags, 7, 2)
    got = {(r.doc_id, r.term): r.w for r in model.weigh(bags).collect()}
    want = {}
    for (d, _), bag in docs.items():
        raw = {t: (1 + math.log(n)) * (math.log(8 / (1 + df[t])) + 1) for t, n in bag.items() if df[t] >= 2}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(d, t): x / norm for t, x in raw.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    other = TextBags(merged, ["label_idx"], (1, high))   # texts the model does not know
    assert {(r.doc_id, r.term): round(r.w, 9) for r in model.weigh(other).collect()} == {k: round(x, 9) for k, x in got.items()}


@pytest.mark.parametrize("scaled,limit", [(False, 0), (True, lk.BROADCAST_BYTES)])
def test_bayes_over_texts_equals_bayes_over_bags(spark, monkeypatch, scaled, limit):
    monkeypatch.setattr(lk, "BROADCAST_BYTES", limit)
    texts = [(i, i % 3, i % 2, " ".join(f"w{(i * j) % (5 + i % 3)}{i % 3}" for j in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, fold int, label_idx int, text string")
    for held in ([[None], [0, 1, 2]] if scaled else [[0, 1, 2]]):
        carry = ["label_idx"] + ["fold"] * (held != [None])
        out = []
        for bags, new in ((terms.bag_of_terms(docs, carry=carry), terms.bag_of_terms(docs, carry=carry)), (TextBags(docs, carry), TextBags(docs, carry))):
            model = bayes.fit_text_bayes(bags, docs, ["a", "b"], held, 2, scaled).models([0.1, 1.0])
            out += [{r.doc_id: r for r in model.scores(b, docs).collect()} for b in (bags, new)]
        for other in out[1:]:
            assert all(abs(other[d][c] - r[c]) < 1e-9 for d, r in out[0].items() for c in ("score_0", "score_1", "score_2", "score_3"))


def test_no_row_per_document_and_term_moves_or_is_kept(spark):
    docs = frame(spark)
    bags = TextBags(docs, ["label_idx"])
    model = bayes.fit_text_bayes(bags, docs, ["a", "b"], min_df=1).model()
    plan = model._block_sums(bags)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "term" not in plan.split("FlatMapCoGroupsInArrow")[0]
    assert "tokens" in "".join(bags.rows.columns) and "term" not in bags.rows.columns
