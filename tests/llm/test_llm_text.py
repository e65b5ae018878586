"""Line dedup, license scans, quality rules and secret scans against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from helpers_llm import prose, texts
from pyspark.sql import functions as F

from pressmark.llm import license_scan, line_dedup, quality_rules, secret_scan

SPACE = r"[^\x20\x09-\x0D]+"


# --- line dedup -----------------------------------------------------------------------


def cut(text, divisor=line_dedup.DIVISOR):
    """Chunks of a text: (place, lines, body)."""
    lines = text.split("\n")
    v = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    bounds = [i for i in range(len(lines) - 1) if (v[i] * line_dedup.FACTOR + v[i + 1]) % divisor]
    spans = [(a, a + 2) for a in bounds] + [(a, b + 2) for a, b in zip(bounds, bounds[1:]) if b > a + 2]
    return [(a, b - a, "\n".join(lines[a:b])) for a, b in spans]


def deduped(rows, hashes):
    """Brute force; ``hashes`` gives the order of texts under one id."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])
    first, out = {}, {}
    for doc in sorted({r for r in rows if r[1] is not None}, key=key):
        lines, gone = doc[1].split("\n"), set()
        for place, n, body in sorted(cut(doc[1])):
            if re.search(r"[^\s]", body, re.A):
                at = first.setdefault(body, (doc, place))
                if at[0] != doc or place >= at[1] + n:
                    gone |= set(range(place, place + n))
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return [(r[0], *out.get(r, (None, 0, 0))) for r in rows]


def test_line_dedup_equals_brute_force(spark, odd, small):
    block = "\n".join(prose(8, i) for i in range(30))
    more = spark.createDataFrame(
        [(100 + i, f"{prose(9, 1000 + i)}\n{block}\n{prose(9, 2000 + i)}") for i in range(6)]
        + [(200, block + "\n" + block), (201, "\n\n\n\n\n\n"), (202, block), (203, "s\n" * 9)], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(more).unionByName(small.select("doc_id", "text"))
    rows = texts(docs)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want = Counter(deduped(rows, hashes))
    for most in (line_dedup.BROADCAST_BYTES, 0):  # all repeated chunks broadcast, or the frequent ones only
        found = line_dedup.line_dedup(docs, broadcast_bytes=most)
        assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()) == want
    assert sum(n for *_, n in want) > 50


def test_surroundings_change_no_chunk_of_a_passage():
    lines = [prose(8, i) for i in range(60)]
    passage = {body for _, _, body in cut("\n".join(lines[20:40]))}
    assert passage <= {body for _, _, body in cut("\n".join(lines))}
    a, b = cut("\n".join(lines)), cut("\n".join([*lines[:30], "new", *lines[30:]]))
    assert len({c[2] for c in a} - {c[2] for c in b}) <= 3


def test_line_dedup_recall_by_length(spark):
    """Passages between unlike surroundings: the share of lines that leave the second place; nothing else does."""
    rows, lines = [], Counter()
    for n in (2, 3, 4, 8, 30):
        for s in range(100):
            block = [f"{n}.{s}.{i} {prose(6, i)}" for i in range(n)]
            for k in range(2):
                around = [[f"{side}{n}.{s}.{k}.{i} {prose(6, i)}" for i in range(3)] for side in "pq"]
                rows.append((10_000 * n + 2 * s + k, "\n".join(around[0] + block + around[1])))
            lines[n] += n
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, want = Counter(), Counter()
    for i, text, _, removed in deduped(rows, {t: 0 for _, t in rows}):
        want[i // 10_000] += removed
    for r in line_dedup.line_dedup(docs).collect():
        got[r["doc_id"] // 10_000] += r["n_removed"]
        assert r["doc_id"] % 2 or not r["n_removed"]
        assert [x for x in r["text"].split("\n") if x[0] in "pq"] == [x for x in dict(rows)[r["doc_id"]].split("\n") if x[0] in "pq"]
    assert got == want
    share = {n: got[n] / lines[n] for n in lines}
    assert share[2] > 0.7 and share[3] > 0.8 and share[4] > 0.85 and share[8] > 0.92 and share[30] > 0.97, share


def test_line_dedup_keeps_other_columns_and_rows(odd, empty):
    found = line_dedup.line_dedup(odd)
    assert found.columns == [*odd.columns, "n_lines", "n_removed"] and found.count() == odd.count()
    other = [c for c in odd.columns if c != "text"]
    assert Counter(map(tuple, found.select(other).collect())) == Counter(map(tuple, odd.select(other).collect()))
    assert line_dedup.line_dedup(empty).count() == 0


def without_passages(rows, hashes):
    """Brute force over pairs of neighbouring lines; rows are (doc_id, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])
    first, out = {}, {}
    for doc in sorted({r for r in rows if r[1] is not None}, key=key):
        lines, gone = doc[1].split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            if re.search(r"[^\s]", "".join(pair), re.A) and first.setdefault(pair, (doc, i)) not in [(doc, i), (doc, i - 1)]:
                gone |= {i, i + 1}
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return [(r[0], *out.get(r, (None, 0, 0))) for r in rows]


def test_passage_dedup_equals_brute_force(spark, odd, small, empty):
    made = ["a\nb\nc", "x\nb\nc\ny", "s\ns\ns\ns\ns", "s\ns", "\n\n\n\n", "c\ny", "p\n\nq", "r\np\n\nq"]
    docs = odd.select("doc_id", "text").unionByName(small.select("doc_id", "text")).unionByName(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string"))
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    found = [tuple(r) for r in line_dedup.passage_dedup(docs).select("doc_id", "text", "n_lines", "n_removed").collect()]
    assert Counter(found) == Counter(without_passages(texts(docs), hashes))
    got = {i: t for i, t, _, _ in found}
    assert [got[1000 + i] for i in range(4)] == ["a\nb\nc", "x\ny", "s\ns", ""]
    whole = line_dedup.passage_dedup(odd)
    assert whole.columns == [*odd.columns, "n_lines", "n_removed"] and whole.count() == odd.count()
    assert line_dedup.passage_dedup(empty).count() == 0


def test_shared_passages_go_at_every_length(spark):
    """Unlike surroundings: the second place of a passage goes whole, its surroundings stay."""
    rows, want = [], {}
    for n in (2, 3, 4, 5, 8, 10, 30):
        for s in range(10):
            block = [f"{prose(8, s)} {n}.{s}.{i}" for i in range(n)]
            for k in range(2):
                around = [[f"{side}{n}.{s}.{k}.{i} {prose(6, i)}" for i in range(5)] for side in "pq"]
                rows.append((len(rows), "\n".join(around[0] + block + around[1])))
                want[rows[-1][0]] = "\n".join(around[0] + around[1]) if k else rows[-1][1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert dict(texts(line_dedup.passage_dedup(docs))) == want


# --- quality rules --------------------------------------------------------------------


def measured(text):
    words = re.findall(SPACE, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i:i + 5])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(quality_rules.SYMBOLS, text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures_and_base_rules_equal_brute_force(spark, odd, small):
    docs = odd.select("doc_id", "text", "lang").unionByName(small.select("doc_id", "text", "lang"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = Counter((r["doc_id"], *(r[m] for m in quality_rules.MEASURES[:5]), r["base_failed"], r["kept"])
                  for r in quality_rules.judged(docs, labels).collect())
    want = Counter()
    for i, t in texts(docs):
        m = measured(t)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        want[(i, *m, failed, not failed)] += 1
    assert got == want


def test_the_binomial_bound_is_exact(spark):
    cases = [(0, 100, 0.01), (3, 500, 0.005), (1, 40, 0.02), (12, 3000, 0.005), (0, 1, 0.3), (2, 2, 0.5), (40, 20000, 0.0025), (5, 5, 0.001)]
    df = spark.createDataFrame([(e, n) for e, n, _ in cases], "e bigint, n bigint")
    for i, (e, n, risk) in enumerate(cases):
        got = df.where((F.col("e") == e) & (F.col("n") == n)).select(quality_rules.at_most(F.col("e"), F.col("n"), risk)).first()[0]
        want = sum(math.comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(e + 1))
        assert got == pytest.approx(1.0 if e > n * risk else want, rel=1e-9)


def test_cutoffs_are_guaranteed_for_every_stratum(spark):
    clean, signs = "word " * 50, "word## " * 50
    rows = [(i, clean, "a") for i in range(4000)] + [(4000 + i, signs, "a") for i in range(300)]
    rows += [(5000 + i, clean if i % 10 else signs, "b") for i in range(4000)] + [(9500 + i, clean, "c") for i in range(50)] + [(9600, signs, "c")]
    # no repeats: every word differs
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn(
        "text", F.expr("array_join(transform(split(trim(text), ' '), (w, i) -> concat(w, char(97 + i % 26), i)), ' ')"))
    labels = docs.where("NOT (lang = 'a' AND text LIKE '%##%')").select("doc_id", F.lit(1).alias("quality")).unionByName(
        docs.where("lang = 'a' AND text LIKE '%##%'").select("doc_id", F.lit(0).alias("quality")))
    found = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, labels).collect()}
    assert not any(found[4000 + i] for i in range(300)), "signs are rejected where good documents have none"
    assert all(found[i] for i in range(4000))
    assert all(found[5000 + i] for i in range(4000)), "a tenth of the good documents of b has signs: no cutoff may hit them"
    assert found[9600], "too few labels in c to reject anything"


def test_kept_rows_are_unchanged(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (None, 1), (4, None), (7, 0), (7, 1)], "doc_id bigint, quality int")
    kept = quality_rules.keep_good(odd, labels)
    good = Counter(tuple(r) for r in odd.collect() if measured(r["text"])[0] >= 10 and measured(r["text"])[4] * 5 <= measured(r["text"])[0])
    assert kept.columns == odd.columns and Counter(tuple(r) for r in kept.collect()) == good
    assert quality_rules.judged(empty, labels).count() == 0


# --- secret scans ---------------------------------------------------------------------

KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def entropy(s):
    peaks = []
    for i in range(len(s) - secret_scan.WINDOW + 1):
        c = Counter(s[i:i + secret_scan.WINDOW])
        peaks.append(-sum(n / secret_scan.WINDOW * math.log2(n / secret_scan.WINDOW) for n in c.values()))
    return max(peaks, default=0.0)


def scanned(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base.sort()
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        s = m[0]
        bits = secret_scan.HEX_BITS if re.fullmatch("[0-9a-f]+", s) else secret_scan.MIXED_BITS
        if (not any(a < m.end() and m.start() < b for a, _, b in base) and re.search("[A-Za-z]", s) and re.search("[0-9]", s)
                and not any(x in s for x in secret_scan.ALLOWED) and entropy(s) >= bits):
            found.append((m.start(), 3, m.end()))
    return base, sorted(base + found)


def test_spans_equal_brute_force(spark, odd, small):
    made = ["token=ab token = 'abcdef' PassWord:\"x.y-z=1\"", "secret=token: abcdefgh api_key=12345 apikey=123456", "é" * 9 + "AKIA" + "B" * 16 + "AKIA2",
            "0123456789abcdef01234567 " * 3, "x" + "a1b2c3d4e5f60718293a4b5c" + "g", "q7Zt9Kx2Lm4Np8Rs1Vw5Yb", "q7Zt9Kx2Lm4Np8RsEXAMPLE",
            "entekeitschpfkeitberaaaa", "🙂 token=abcdef🙂 3f9a1c7e5b2d8046af13", "token=" * 40, "".join(f"password={i:06d}x " for i in range(700)),
            "9f8e7d6c5b4a3f2e1d0c", "AKIA" * 30, "a" * 5000 + "1" * 30, "Ab1" * 40, "ſecret=abcdefgh toKen=abcdefgh"]
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    docs = docs.unionByName(odd.select("doc_id", "text")).unionByName(small.select("doc_id", "text"))
    got = Counter((r["doc_id"], tuple(map(tuple, r["base_spans"])), tuple(map(tuple, r["all_spans"])))
                  for r in secret_scan.secret_scan(docs).collect())
    want = Counter((i, *(tuple(x) for x in scanned(t))) for i, t in texts(docs))
    assert got == want
    kinds = Counter(k for _, _, spans in got for _, k, _ in spans)
    assert all(kinds[k] for k in range(4))


def test_spans_are_listed_by_place(spark):
    row = spark.createDataFrame([("token=abcdefabcdefabcdefabcdef",)], "text string").select(
        secret_scan.listed(secret_scan.spans(F.col("text"))["base"])).first()[0]
    assert row == "assign:0:30,hex:6:30"


def test_random_keys_are_found_in_every_class(spark):
    """At least 92 % of random keys of each class and length are redacted; expected are 95.7 % (base62 of 20 characters) or more."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    classes = {"hex": digits + "abcdef", "HEX": digits + "ABCDEF", "hEx": digits + "abcdefABCDEF", "base32": upper + "234567",
               "lower": digits + lower, "upper": digits + upper, "base62": digits + lower + upper}
    rng = random.Random(5)
    rows = [(name, n, "".join(rng.choice(chars) for _ in range(n)))
            for name, chars in classes.items() for n in (20, 32, 40, 64) for _ in range(400)]
    docs = spark.createDataFrame([(i, f"key {k} end") for i, (_, _, k) in enumerate(rows)], "doc_id bigint, text string")
    got = dict(texts(secret_scan.redact(secret_scan.secret_scan(docs))))
    found = Counter(rows[i][:2] for i, t in got.items() if t == "key [REDACTED] end")
    assert {k: found[k] for k in {r[:2] for r in rows} if found[k] < 368} == {}


def test_keys_beside_known_forms_and_allowed_words_are_found(spark):
    key, hexed = "q7Zt9Kx2Lm4Np8Rs1Vw5YbH3dGc6Fj0TaQeUiOzX", "9F8E7D6C5B4A3F2E1D0C"
    made = [f"AKIA{'Z' * 16}/{key}", f"see /docs/example/{key} end", f"🙂 example-{hexed}_EXAMPLE", f"{key}EXAMPLE", f"a/example/{key[:18]}", key]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = dict(texts(secret_scan.redact(secret_scan.secret_scan(docs))))
    mark = "[REDACTED]"
    assert got == {0: mark * 2, 1: f"see /docs/example{mark} end", 2: f"🙂 example{mark}EXAMPLE", 3: made[3], 4: made[4], 5: mark}


def test_redaction_hides_every_span(odd, spark, empty):
    made = ["a token=abcdefabcdefabcdefabcdef b", "🙂 password=secret1 🙂", "nothing", "", None, "AKIA" + "Z" * 16]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(secret_scan.secret_scan(docs)).collect()}
    assert got == {0: "a [REDACTED] b", 1: "🙂 [REDACTED] 🙂", 2: "nothing", 3: "", 4: None, 5: "[REDACTED]"}
    whole = secret_scan.secret_scan(odd)
    assert whole.columns == [*odd.columns, "base_spans", "all_spans"] and whole.count() == odd.count()
    assert secret_scan.secret_scan(empty).count() == 0


# --- license scans --------------------------------------------------------------------


def base_of(text):
    words = license_scan.split(text or "")
    found = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    places = sorted(i for i, _ in found)
    return (len(words), len(found), places[0] if places else None, places[-1] if places else None, ",".join(sorted({x for _, x in found})))


def test_licenses_equal_brute_force(spark, odd, small):
    notice = {label: text for label, text, _ in reversed(license_scan.TEMPLATES)}
    made = ["MIT license mit  LICENSE", "mit-license; general public\nlicense", "mité license", "Mit İ license", prose(30, 1) + " " + notice["bsd"],
            notice["mpl"].upper(), "the software is free", notice["gpl"].replace("either", ""), "Licensed under CC BY-NC 4.0.",
            " ".join(reversed(notice["bsd"].split())), notice["bsd"].replace("binary", "other").replace("source", "other"), "mit", "license mit license"]
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    docs = docs.unionByName(odd.select("doc_id", "text")).unionByName(small.select("doc_id", "text"))
    found = license_scan.license_scan(docs).toPandas()
    none = lambda x: None if pd.isna(x) else int(x)
    got = Counter((none(r.doc_id), r.n_words, r.n_base, none(r.first_word), none(r.last_word), r.base_labels) for r in found.itertuples())
    assert got == Counter((i, *base_of(t)) for i, t in texts(docs))
    labels = {r.doc_id: (r.labels, r.score) for r in found.itertuples() if r.doc_id >= 1000}
    assert labels[1004][0] == "bsd" and labels[1005][0] == "mpl" and labels[1008][0] == "cc-by-nc"
    assert labels[1006] == ("", 0.0) and labels[1009] == ("", 0.0) and labels[1010] == ("", 0.0)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in found.itertuples())
    place = next(m for r in found.itertuples() if r.doc_id == 1004 for m in r.matches)
    assert place["start"] == 30 + sum("-" in w for w in prose(30, 1)) and place["share"] == 1.0


def test_no_documents_have_no_licenses(empty):
    assert license_scan.license_scan(empty).count() == 0


def test_a_key_phrase_must_be_in_its_notice():
    with pytest.raises(ValueError):
        license_scan.Index([("x", "some words", ["other words"])], {})
