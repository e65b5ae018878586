"""Column functions over raw text.  Everything here stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# They decide the results and must not change.
OCR_CHARS = "|_=()[]<>#/\\*~`«»®^°•★■{}™§♦±►и✓з□▼"
SPACES = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
OTHER_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TERM = r"[\p{L}\p{M}\p{N}_]{2,}"
WORD = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
SENTENCE = r"[^.!?]*[^.!?\s][^.!?]*(?:[.!?]+|$)"
QUOTE = (
    r"""(?sU)(„|‚‚|,,|"|”|'|’)(\s\w|\w\w?)"""
    r"""(?:(?!„|‚‚|,,|\s"\w\w|\s”\w\w|\s'\w\w|\s’\w\w).){0,1000}?("|”|'|’)($|[^\w])"""
)
CURRENCY = "[$€£ƒ]"

# What a stop word must not touch on either side.
_IN_WORD = r"[\p{L}\p{N}_]"
# A run of word characters with the blanks behind it, or anything else.
_WORD_AND_BLANKS = r"(?U)[\p{L}\p{N}_]+\s*|[^\p{L}\p{N}_]+"


def clean_ocr(text: Column) -> Column:
    """Drop OCR noise characters and collapse every run of white space to one blank."""
    # one pass maps every other blank to ' ' and drops the noise; the pattern left is a plain literal run
    plain = F.translate(text, OTHER_SPACES + OCR_CHARS, " " * len(OTHER_SPACES))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def hash_text(text: Column) -> Column:
    return F.sha1(text)


def may_hold_quote(text: Column) -> Column:
    """Cheap test that spares most rows the backtracking quote pattern."""
    return text.rlike("""["”'’]""")  # every match ends in a closing mark


def quote_count(text: Column) -> Column:
    count = F.regexp_count(text, F.lit(QUOTE))
    return F.when(may_hold_quote(text), count).otherwise(F.lit(0))


def remove_quotes(text: Column) -> Column:
    return F.when(may_hold_quote(text), F.regexp_replace(text, QUOTE, "")).otherwise(text)


def remove_stop_words(text: Column, words: Sequence[str]) -> Column:
    """Delete whole-word matches (any case) and the blanks behind them.

    Lists of plain words, short or long, are looked up word by word; a list with an entry that
    holds other characters is one pattern with the same word borders.
    """
    listed = [w for w in words if w]
    if not listed:
        return text
    if all(re.fullmatch(r"\w+", w) for w in listed):
        lowered = sorted({w.lower() for w in listed})
        parts = F.regexp_extract_all(text, F.lit(_WORD_AND_BLANKS), F.lit(0))
        kept = F.filter(parts, lambda p: ~F.lower(F.rtrim(p, F.lit(OTHER_SPACES + " "))).isin(lowered))
        return F.array_join(kept, "")
    alternatives = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in listed)
    return F.regexp_replace(text, rf"(?iuU)(?<!{_IN_WORD})({alternatives})(?!{_IN_WORD})\s*", "")


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE))


def words(text: Column) -> Column:
    """Word and punctuation tokens."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def vector_terms(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with low <= n <= high; tokens of one gram are joined by a blank."""
    if (low, high) == (1, 1):
        return tokens
    size = F.size(tokens)
    grams = []
    for n in range(low, high + 1):
        gram = tokens
        for shift in range(1, n):
            # shorten the left side, so zip_with never pads with null
            gram = F.zip_with(
                F.slice(gram, F.lit(1), F.greatest(size - shift, F.lit(0))),
                F.slice(tokens, F.lit(shift + 1), F.greatest(size - shift, F.lit(0))),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        grams.append(F.when(size >= n, gram).otherwise(F.slice(tokens, 1, 0)))
    return F.concat(*grams)


def split_long_sentences(sents: Column, max_tokens: int = 450) -> Column:
    """Cut sentences of more than max_tokens blank-separated tokens; full chunks end in '.'."""

    def chunks(sentence: Column) -> Column:
        tokens = F.split(sentence, " ")
        starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(max_tokens))
        return F.transform(
            starts,
            lambda i: F.concat(
                F.array_join(F.slice(tokens, i + 1, max_tokens), " "),
                F.when(i + max_tokens < F.size(tokens), ".").otherwise(""),
            ),
        )

    return F.flatten(F.transform(sents, chunks))


def ratio(count: Column, total: Column) -> Column:
    """count / total, 0 when total is 0."""
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def truncated_percent(score: Column) -> Column:
    """Score cut (not rounded) to four decimals, as a percentage.

    The last bits of a sum depend on its order; twelve decimals are kept before the
    cut, so that 0.612 does not become 61.19.
    """
    return F.floor(F.round(F.abs(score) * 10000, 8)) * F.signum(score) / 100.0
