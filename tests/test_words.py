"""Learned abbreviations and stems by rules."""

import time

from pressmark.operators import abbreviations, stems

# Published pairs of the Dutch rules.
PAIRS = {
    "lichaam": "licham", "lichamelijk": "licham", "lichamelijke": "licham", "lichamelijkheden": "licham", "lichamen": "licham",
    "licht": "licht", "lichte": "licht", "lichten": "licht", "opgingen": "opging", "opglimping": "opglimp", "opglimpingen": "opglimp",
    "opgroeien": "opgroei", "opgroeiplaats": "opgroeiplat", "ophalen": "ophal", "ophalers": "ophaler", "opheldering": "ophelder",
    "ophoping": "ophop", "ophouden": "ophoud", "maan": "man", "brood": "brod", "bedden": "bed", "mogelijkheid": "mogelijk",
}


def test_published_pairs(spark):
    words = spark.createDataFrame([(w,) for w in PAIRS] + [(None,), ("",), ("y",)], "word string")
    got = {r["word"]: r["stem"] for r in stems.with_stems(words).collect()}
    assert {w: got[w] for w in PAIRS} == PAIRS
    assert got[None] is None and got[""] == "" and got["y"] == "y"


def test_words_are_counted_once(spark):
    docs = spark.createDataFrame([("Bedden, bedden! 12",), (None,), ("bed",)], "text string")
    assert sorted(map(tuple, stems.stem_table(docs).collect())) == [("bed", 1, "bed"), ("bedden", 2, "bed")]


def test_abbreviations_do_not_end_sentences(spark):
    plain = [f"De man zag het huis nummer {i}. Het groot oud huis daar was groot en oud. Hij ging daar naar huis." for i in range(40)]
    texts = plain + [f"Dr. Jansen woont op nr. {i} b.v. daar. Hij is oud." for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = abbreviations.known(abbreviations.learn(docs))
    assert {"dr", "nr", "b.v"} <= set(found) and not {"huis", "oud", "groot", "daar"} & set(found)
    more = spark.createDataFrame([(1, "Dr. Smit zag nr. 5. Mooi! Het e.d. was"), (2, None), (3, ""), (4, "...")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["sentences"] for r in abbreviations.with_sentences(more, found).collect()}
    assert got[1] == ["Dr. Smit zag nr. 5.", " Mooi!", " Het e.d.", " was"]
    assert not got[2] and got[3] == [] and got[4] == []
    assert abbreviations.with_sentences(more, []).count() == 4


def test_a_long_text_is_cut_in_time_with_its_length(spark):
    """Every boundary was once worked out anew for every sentence."""
    n = 12_000
    docs = spark.createDataFrame([(1, "Hij zag nr. 5. " * n)], "doc_id bigint, text string")
    began = time.time()
    got = abbreviations.with_sentences(docs, ["nr"]).first()["sentences"]
    assert time.time() - began < 20
    assert got == ["Hij zag nr. 5."] + [" Hij zag nr. 5."] * (n - 1) or (got[:2] == ["Hij zag nr. 5.", " Hij zag nr. 5."] and len(got) - n in (0, 1))
