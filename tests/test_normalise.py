"""Word normalisation by a dictionary."""

import re

import pytest

from pressmark.operators import annotation
from pressmark.plans import lookup

FORMS = {"katten": "kat", "Huizen": "huis", "leeg": "", "!": "?"}


def by_hand(rows):
    """Rows of one doc_id share their parts, in the order of place, then part; a null doc_id has no text."""
    forms = {f.lower(): b for f, b in FORMS.items()}
    placed = {}
    for i, text in rows:
        for pos, part in enumerate(re.findall(r"\w+|\W+", text or "")):
            placed.setdefault(i, []).append((pos, forms.get(part.lower(), part)))
    return sorted((str(i), "".join(p for _, p in sorted(placed.get(i, []))) if i is not None else "") for i, _ in rows)


@pytest.mark.parametrize("limit", [lookup.BROADCAST_BYTES, 1])
def test_listed_words_are_replaced_in_place(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    rows = [(1, "Katten, huizen en KATTEN!"), (2, None), (3, ""), (4, "  leeg  katten"), (5, "niets"), (6, "!"), (None, "katten"),
            (7, "katten een"), (7, "twee huizen ! drie"), (8, "katten katten"), (8, "katten katten")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(list(FORMS.items()), "form string, base string")
    out = annotation.normalise_text(docs, table)
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == by_hand(rows)


def test_only_listed_forms_come_back_to_the_text(spark):
    """Every part of every text was once collected, sorted by place and, beyond the broadcast limit, shuffled by form."""
    docs = spark.createDataFrame([(i, "katten zijn geen huizen " * 3) for i in range(20)], "doc_id bigint, text string")
    table = spark.createDataFrame(list(FORMS.items()), "form string, base string")
    plan = annotation.normalise_text(docs, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "array_distinct" in plan
