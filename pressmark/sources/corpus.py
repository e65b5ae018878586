"""Labelled corpora: line-oriented text, CSV, stop-word lists, token tables, parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import OTHER_SPACES
from ..plans.lookup import broadcast_small
from ..plans.staging import settle

# The line format.
LABEL_MARK = "__label__"
MAX_METADATA = 20
METADATA = rf"^(?:(?:\S*{LABEL_MARK}\S*|\w*=\S*) ){{1,{MAX_METADATA}}}"
DATE_FORMAT = "dd/MM/yyyy"
TOKEN_SCHEMA = (
    "doc_id bigint, sent_idx int, tok_idx int, word string, lemma string, morph string, pos string, ner string"
)


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``doc_id``: 0-based position over files (by path) and lines.

    Counting the lines of each file split gives the offset of the split; within it
    the running row number is enough, so the lines never move.
    """
    placed = lines.withColumn("_path", F.col("_metadata.file_path")).withColumn(
        "_start", F.col("_metadata.file_block_start")
    ).withColumn("_mid", F.monotonically_increasing_id())
    splits = placed.groupBy("_path", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per file split, known by a hash of its path
    before = Window.partitionBy(F.lit(0)).orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    numbered = placed.withColumn("_file", F.xxhash64("_path", "_start")).join(
        broadcast_small(settle(offsets.select(F.xxhash64("_path", "_start").alias("_file"), "_offset"))), "_file")
    return numbered.select((F.col("_mid") + F.col("_offset")).alias("doc_id"), *lines.columns)


def parse_labelled_lines(lines: DataFrame, value: str = "value", date_format: str = DATE_FORMAT) -> DataFrame:
    """Metadata, label and text of ``[__label__X|KEY=value ]* text`` lines.

    The last label and the last value of a key win; unknown keys are ignored.
    ``error`` says what is missing, null for a good line.
    """
    carried = [c for c in lines.columns if c != value]
    line = F.rtrim(F.col(value), F.lit(OTHER_SPACES + " "))
    # an all-metadata line has no text; the blank lets the pattern take its last token
    split = lines.select(*carried, F.concat(line, F.lit(" ")).alias("_line")).withColumn(
        "_prefix", F.regexp_extract("_line", METADATA, 0)
    )
    tokens = F.split(F.rtrim("_prefix"), " ")
    labelled = F.filter(tokens, lambda t: F.contains(t, F.lit(LABEL_MARK)))
    split = split.select(
        *carried,
        F.rtrim(F.expr("substring(_line, length(_prefix) + 1)")).alias("raw_text"),
        F.regexp_extract(F.try_element_at(labelled, F.lit(-1)), rf"{LABEL_MARK}(.*)", 1).alias("label"),
        F.filter(tokens, lambda t: ~F.contains(t, F.lit(LABEL_MARK))).alias("_pairs"),
    )

    def value_of(key: str) -> Column:
        found = F.filter("_pairs", lambda t: F.startswith(t, F.lit(key + "=")))
        return F.substring(F.try_element_at(found, F.lit(-1)), len(key) + 2, 1 << 30)

    date = F.try_to_date(value_of("DATE"), date_format)
    return split.select(
        *carried, "raw_text", "label",
        date.alias("date"), F.year(date).alias("year"),
        value_of("NEWSPAPER").alias("newspaper"),
        value_of("PAGE").try_cast("int").alias("page"),
        F.coalesce(F.split(value_of("URLS"), ","), F.array().cast("array<string>")).alias("urls"),
        F.when(F.col("label").isNull(), "no label")
        .when(F.col("raw_text") == "", "no text").alias("error"),
    )


def read_labelled_lines(
    spark: SparkSession, path: str | Sequence[str], date_format: str = DATE_FORMAT, mode: str = "quarantine"
) -> tuple[DataFrame, DataFrame]:
    """(articles, bad_rows).  ``mode='strict'`` fails the load at the first bad line.

    The strict load reads the lines once more: one counting pass finds the smallest bad line number.
    """
    paths = [path] if isinstance(path, str) else list(path)
    parsed = parse_labelled_lines(with_line_numbers(spark.read.text(paths)), "value", date_format)
    bad = parsed.where(F.col("error").isNotNull()).select("doc_id", "raw_text", "label", "error")
    if mode == "strict":
        # decided before a frame is returned: no later projection, count or grouping can prune the check away
        first = bad.agg(F.min(F.struct("doc_id", "error")).alias("b")).first()["b"]
        if first is not None:
            raise ValueError(f"Error in line {first['doc_id']}: {first['error']}")
        return parsed.drop("error"), bad
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    return parsed.where(F.col("error").isNull()).drop("error"), bad


def read_labelled_csv(
    spark: SparkSession, path: str | Sequence[str], text_col: str = "text", label_col: str = "label",
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header; the text and label columns are required, others are dropped.

    Texts may hold line feeds by default; then a file is one task.  ``multi_line=False`` lets Spark split
    large files.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.csv(paths, header=True, multiLine=multi_line, quote='"', escape='"')
    missing = [c for c in (text_col, label_col) if c not in rows.columns]
    if missing:
        raise ValueError(f"column(s) {', '.join(missing)} not in the header")
    return with_line_numbers(rows).select(
        "doc_id", F.col(text_col).alias("raw_text"), F.col(label_col).alias("label")
    )


_FORMATS = {
    "csv": lambda spark, path, **kw: read_labelled_csv(spark, path, **kw),
    "lines": lambda spark, path, **kw: read_labelled_lines(spark, path, **kw)[0],
}


def read_corpus(spark: SparkSession, path: str | Sequence[str], fmt: str, **options) -> DataFrame:
    if fmt not in _FORMATS:
        raise ValueError(f"unknown corpus format {fmt!r}, use one of {sorted(_FORMATS)}")
    return _FORMATS[fmt](spark, path, **options)


def require_articles(articles: DataFrame) -> DataFrame:
    """Fail early on a corpus without a single labelled article."""
    if articles.where(F.col("label").isNotNull()).isEmpty():
        raise ValueError("the corpus holds no labelled article")
    return articles


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, empty lines dropped."""
    return spark.read.text(path).where(F.col("value") != "").select(F.col("value").alias("word"))


def write_corpus(articles: DataFrame, path: str, source_id: str) -> None:
    articles.withColumn("source_id", F.lit(source_id)).write.mode("append").partitionBy("source_id").parquet(path)


def read_written_corpus(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("source_id") == source_id)


def read_tokens(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Annotated tokens; rows with a missing tagger value (sentence breaks) are dropped."""
    reader = spark.read.schema(TOKEN_SCHEMA)
    rows = reader.parquet(path) if fmt == "parquet" else reader.option("sep", "\t").option("quote", "").csv(path)
    return drop_breaks(rows)


def drop_breaks(tokens: DataFrame) -> DataFrame:
    columns = [c for c in ("word", "lemma", "morph", "pos", "ner") if c in tokens.columns]
    return tokens.dropna(how="any", subset=columns)
