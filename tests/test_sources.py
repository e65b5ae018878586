import csv
import gzip
import os

import pytest

from pressmark.sources import archive, corpus
from pressmark.streaming.archive_scoring import archive_stream, score_stream

FULL = ("__label__NIE DATE=10/04/1985 NEWSPAPER=06De_Telegraaf PAGE=3 LENGTH=237 "
        "URLS=http://resolver/resolve?urn=ddd:1,http://b/2 Man dood na doorzagen elektrische leiding")
LINES = [
    FULL,
    "__label__OPI Wat wilt u op uw scherm zien ?",
    "geen label hier",
    "__label__X DATE=1/2/1960",
    "__label__A DATE=gisteren PAGE=vier enquête x=y blijft",
    "__label__A __label__B KEY=1 tekst __label__C",
]


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_labelled_lines(spark, tmp_path):
    path = write(tmp_path / "c.txt", "\n".join(LINES) + "\n")
    good, bad = corpus.read_labelled_lines(spark, path)
    rows = {r.doc_id: r for r in good.collect()}
    assert sorted(rows) == [0, 1, 4, 5]
    first = rows[0]
    assert (first.label, first.year, first.newspaper, first.page) == ("NIE", 1985, "06De_Telegraaf", 3)
    assert first.urls[0] == "http://resolver/resolve?urn=ddd:1" and first.raw_text.split(" ")[0] == "Man"
    assert str(first.date) == "1985-04-10"
    second = rows[1]
    assert (second.year, second.newspaper, second.page, second.urls) == (None, None, None, [])
    assert second.raw_text.startswith("Wat") and second.label == "OPI"
    assert rows[4].date is None and rows[4].page is None and rows[4].raw_text == "enquête x=y blijft"
    assert rows[5].label == "B" and rows[5].raw_text == "tekst __label__C"
    assert {(r.doc_id, r.error) for r in bad.collect()} == {(2, "no label"), (3, "no text")}


def test_strict_mode_names_the_line_whatever_is_read_later(spark, tmp_path):
    path = write(tmp_path / "c.txt", "\n".join(LINES))
    for read in (lambda d: d.select("raw_text").collect(), lambda d: d.count(), lambda d: d.groupBy("label").count().collect()):
        with pytest.raises(ValueError, match="Error in line 2: no label"):
            read(corpus.read_labelled_lines(spark, path, mode="strict")[0])
    good = write(tmp_path / "g.txt", "__label__A one\n__label__B two")
    rows, bad = corpus.read_labelled_lines(spark, good, mode="strict")
    assert rows.count() == 2 and bad.count() == 0 and "error" not in rows.columns


def test_at_most_twenty_metadata_tokens(spark, tmp_path):
    line = "__label__A " + " ".join(f"K{i}=v" for i in range(25)) + " rest"
    good, _ = corpus.read_labelled_lines(spark, write(tmp_path / "c.txt", line))
    assert good.first().raw_text == " ".join(f"K{i}=v" for i in range(19, 25)) + " rest"


def test_line_numbers_over_many_splits(spark, tmp_path):
    write(tmp_path / "d" / "a.txt", "".join(f"a{i}\n" for i in range(500)))
    write(tmp_path / "d" / "b.txt", "".join(f"b{i}\n" for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = corpus.with_line_numbers(spark.read.text(str(tmp_path / "d"))).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.doc_id for r in rows] == list(range(800))
    assert [r.value for r in rows] == [f"a{i}" for i in range(500)] + [f"b{i}" for i in range(300)]


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "text", "label"])
        out.writerow([1, 'zegt "ja",\nen nee', "10"])
        out.writerow([2, "kort", "9"])
    rows = corpus.read_corpus(spark, str(path), "csv").orderBy("doc_id").collect()
    assert [(r.raw_text, r.label) for r in rows] == [('zegt "ja",\nen nee', "10"), ("kort", "9")]
    with pytest.raises(ValueError, match="body"):
        corpus.read_labelled_csv(spark, str(path), text_col="body")
    with pytest.raises(ValueError, match="unknown corpus format"):
        corpus.read_corpus(spark, str(path), "xml")


def test_stop_words_and_written_corpus(spark, tmp_path):
    assert [r.word for r in corpus.read_stop_words(spark, write(tmp_path / "s.txt", "aan\n\nal\n")).collect()] == ["aan", "al"]
    rows = spark.createDataFrame([(0, "t", "A")], "doc_id bigint, raw_text string, label string")
    corpus.write_corpus(rows, str(tmp_path / "out"), "s1")
    corpus.write_corpus(rows, str(tmp_path / "out"), "s2")
    assert corpus.read_written_corpus(spark, str(tmp_path / "out"), "s2").count() == 1
    with pytest.raises(ValueError):
        corpus.require_articles(rows.where("false"))


def test_tokens_drop_breaks(spark, tmp_path):
    path = write(tmp_path / "t.tsv", "1\t0\t0\tMan\tman\t[man]\tN(soort)\tO\n1\t0\t1\t\t\t\t\t\n")
    assert [r.lemma for r in corpus.read_tokens(spark, path, "tsv").collect()] == ["man"]


def archive_file(root, paper, year, ids):
    os.makedirs(root / paper, exist_ok=True)
    with gzip.open(root / paper / f"{paper}-{year}.txt.gz", "wt", encoding="utf-8") as f:
        for i in ids:
            f.write(f"{i}\tx\ty\tDATE={year}-01-01\ttekst \"{i}\n")


def test_archive_in_and_out(spark, tmp_path):
    archive_file(tmp_path / "in", "courant", 1955, ["a1", "a2"])
    archive_file(tmp_path / "in", "bode", 1956, ["b1"])
    rows = archive.read_archive(spark, str(tmp_path / "in"), partitions=2)
    got = sorted((r.newspaper, r.year, r.id, r.date, r.raw_text) for r in rows.collect())
    assert got[0] == ("bode", 1956, "b1", "1956-01-01", 'tekst "b1')
    from pyspark.sql import functions as F
    archive.write_predictions(rows.withColumn("label", F.lit("NIE")), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 3 and set(back.columns) == {"id", "date", "label", "newspaper", "year"}


def test_growing_archive(spark, tmp_path):
    from pyspark.sql import functions as F
    archive_file(tmp_path / "in", "courant", 1955, ["a1", "a2"])
    def score(df):
        return df.withColumn("label", F.length("raw_text").cast("string"))
    def run():
        rows = archive_stream(spark, str(tmp_path / "in"))
        score_stream(rows, score, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
        return sorted(r.id for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect())
    assert run() == ["a1", "a2"]
    archive_file(tmp_path / "in", "courant", 1956, ["a3"])
    assert run() == ["a1", "a2", "a3"]
