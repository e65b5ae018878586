"""The same results as plain SQL, for the side-by-side check."""

from __future__ import annotations

import csv

from ..operators.style import DUTCH_LEXICON
from . import queries as q

# The SQL side states its patterns and word classes itself, so that a wrong constant on either side shows.
NOISE = "|_=()[]<>#/\\*~`«»®^°•★■{}™§♦±►и✓з□▼"
BLANKS = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
TERM = r"[\p{L}\p{M}\p{N}_]{2,}"
WORD = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
SENTENCE = r"[^.!?]*[^.!?\s][^.!?]*(?:[.!?]+|$)"
CURRENCY = "[$€£ƒ]"
BASIC_NAMES = [
    "question_marks_perc", "exclamation_marks_perc", "currency_symbols_perc", "digits_perc",
    "sentences", "avg_sentence_length",
]
QUOTE_NAME = "direct_quotes_perc"
LINGUISTIC_NAMES = [
    "adjectives_perc", "cogn_verbs_perc", "intensifiers_perc", "modal_adverbs_perc", "modal_verbs_perc",
    "named_entities_perc", "number_perc", "pronoun_1_perc", "pronoun_2_perc", "pronoun_3_perc",
    "unique_named_entities_perc",
]
# category -> (part-of-speech prefix, look up in lower case, feature name)
CLASSES = {
    "pronoun_1": ("VNW", False, "pronoun_1_perc"),
    "pronoun_2": ("VNW", False, "pronoun_2_perc"),
    "pronoun_3": ("VNW", False, "pronoun_3_perc"),
    "modal_verb": ("WW", True, "modal_verbs_perc"),
    "modal_adverb": ("BW", True, "modal_adverbs_perc"),
    "intensifier": (None, True, "intensifiers_perc"),
    "cogn_verb": ("WW", True, "cogn_verbs_perc"),
}

CLEAN = f"trim(regexp_replace(translate(text, '{NOISE}', ''), '{BLANKS}', ' ', 'g'))"
DOCS = f"docs AS (SELECT doc_id, lang AS label, {CLEAN} AS text FROM documents)"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


def bags(source: str = "docs", prefix: str = "") -> str:
    return f"""{prefix}toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS t FROM {source}),
{prefix}grams AS (SELECT doc_id, unnest(list_concat(t, CASE WHEN len(t) >= 2
    THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM {prefix}toks),
{prefix}bags AS (SELECT doc_id, term, count(*) AS tf FROM {prefix}grams GROUP BY doc_id, term)"""


def tfidf(train: str) -> str:
    """CTEs up to w(v, doc_id, term, w); train is (v, doc_id) of the training rows."""
    return f"""train AS ({train}),
sizes AS (SELECT v, count(*) AS n FROM train GROUP BY v),
dfs AS (SELECT v, term, count(*) AS df FROM bags JOIN train USING (doc_id) GROUP BY v, term HAVING count(*) >= 5),
idfs AS (SELECT v, term, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM dfs JOIN sizes USING (v)),
raws AS (SELECT v, doc_id, term, (1 + ln(tf::DOUBLE)) * idf AS raw FROM bags JOIN idfs USING (term)),
w AS (SELECT v, doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY v, doc_id)) AS w FROM raws)"""


SCALED = """cand AS (SELECT v, term, df, n FROM idfs JOIN sizes USING (v) WHERE df > 0.25 * (n - 1)),
vals AS (SELECT v, term, any_value(n) AS n, list(w.w ORDER BY w.w) AS l FROM w JOIN train USING (v, doc_id)
         JOIN cand USING (v, term) GROUP BY v, term),
ranks AS (SELECT v, term, l, n - len(l) AS zeros, [0.25 * (n - 1), 0.75 * (n - 1)] AS pos FROM vals),
ends AS (SELECT v, term, list_transform(pos, lambda p: [
            CASE WHEN floor(p) < zeros THEN 0 ELSE l[floor(p)::BIGINT - zeros + 1] END,
            CASE WHEN ceil(p) < zeros THEN 0 ELSE l[ceil(p)::BIGINT - zeros + 1] END, p - floor(p)]) AS e FROM ranks),
quart AS (SELECT v, term, (e[2][1] + (e[2][2] - e[2][1]) * e[2][3]) - (e[1][1] + (e[1][2] - e[1][1]) * e[1][3]) AS iqr
          FROM ends),
ws AS (SELECT w.v, w.doc_id, w.term, w.w / CASE WHEN iqr > 0 THEN iqr ELSE 1 END AS w
       FROM w LEFT JOIN quart USING (v, term))"""


def bayes(weights: str = "w", alpha: str = "0.1", labelled: str = "docs") -> str:
    """CTEs from weights to scores(v, doc_id, label, score) of every document of docs."""
    return f"""lab AS (SELECT DISTINCT label FROM {labelled}),
prior AS (SELECT v, label, ln(count(*)::DOUBLE / any_value(n)) AS p FROM train JOIN {labelled} USING (doc_id)
          JOIN sizes USING (v) GROUP BY v, label),
sums AS (SELECT v, label, term, sum(x.w) AS s FROM {weights} x JOIN train USING (v, doc_id)
         JOIN {labelled} USING (doc_id) GROUP BY v, label, term),
voc AS (SELECT v, count(*) AS m FROM idfs GROUP BY v),
tot AS (SELECT v, label, sum(s) AS t FROM sums GROUP BY v, label),
lp AS (SELECT i.v, l.label, i.term, ln(coalesce(s, 0) + {alpha}) - ln(t + {alpha} * m) AS lp
       FROM idfs i CROSS JOIN lab l LEFT JOIN sums s ON s.v = i.v AND s.label = l.label AND s.term = i.term
       JOIN voc ON voc.v = i.v JOIN tot ON tot.v = i.v AND tot.label = l.label),
evid AS (SELECT x.v, x.doc_id, lp.label, sum(x.w * lp.lp) AS e FROM {weights} x JOIN test USING (v, doc_id)
         JOIN lp ON lp.v = x.v AND lp.term = x.term GROUP BY x.v, x.doc_id, lp.label),
scores AS (SELECT t.v, t.doc_id, prior.label, prior.p + coalesce(e, 0) AS score FROM test t
           JOIN prior ON prior.v = t.v
           LEFT JOIN evid ON evid.v = t.v AND evid.doc_id = t.doc_id AND evid.label = prior.label),
best AS (SELECT v, doc_id, label AS predicted FROM scores
         QUALIFY row_number() OVER (PARTITION BY v, doc_id ORDER BY score DESC, label) = 1)"""


FOLDS = "folds AS (SELECT doc_id, label, ntile(10) OVER (ORDER BY md5(concat(doc_id, '|42'))) - 1 AS fold FROM docs)"
FOLD_TRAIN = "SELECT x.v, f.doc_id FROM folds f JOIN (SELECT unnest(range({k})) AS v) x ON f.fold <> x.v"
ALL_TRAIN = "SELECT 0 AS v, doc_id FROM docs"


def _cv(weights: str = "w") -> str:
    scaled = SCALED + ",\n" if weights == "ws" else ""
    return f"""WITH {DOCS}, {FOLDS}, {bags()}, {tfidf(FOLD_TRAIN.format(k=10))}, {scaled}
test AS (SELECT fold AS v, doc_id FROM folds), {bayes(weights)},
preds AS (SELECT doc_id, fold, label AS truth, predicted FROM best JOIN folds USING (doc_id))"""


def _full(weights: str = "w") -> str:
    scaled = SCALED + ",\n" if weights == "ws" else ""
    return f"""WITH {DOCS}, {bags()}, {tfidf(ALL_TRAIN)}, {scaled}
test AS (SELECT 0 AS v, doc_id FROM docs), {bayes(weights)}"""


def metrics(source: str, by: str = "pipeline_id") -> str:
    """CTEs ending in result: the metrics per group of source(by, doc_id, truth, predicted)."""
    return f"""cm AS (SELECT {by}, truth, predicted, count(*) AS n FROM {source} GROUP BY ALL),
sup AS (SELECT {by}, truth AS label, sum(n) AS support, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS hits
        FROM cm GROUP BY ALL),
cal AS (SELECT {by}, predicted AS label, sum(n) AS called FROM cm GROUP BY ALL),
cls AS (SELECT {by}, label, coalesce(support, 0)::DOUBLE AS support, coalesce(hits, 0)::DOUBLE AS hits,
        coalesce(called, 0)::DOUBLE AS called FROM sup FULL JOIN cal USING ({by}, label)),
pr AS (SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0 END AS p,
       CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM cls),
prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr),
sc AS (SELECT {by}, sum(p * support) / sum(support) AS precision_weighted, sum(hits) / sum(called) AS precision_micro,
       avg(p) AS precision_macro, sum(r * support) / sum(support) AS recall_weighted,
       sum(hits) / sum(support) AS recall_micro, avg(r) AS recall_macro,
       sum(f * support) / sum(support) AS fmeasure_weighted, sum(hits) / sum(support) AS fmeasure_micro,
       avg(f) AS fmeasure_macro,
       (sum(hits) / sum(support) - sum(support * called) / (sum(support) * sum(support)))
         / (1 - sum(support * called) / (sum(support) * sum(support))) AS cohens_kappa
       FROM prf GROUP BY ALL),
pos AS (SELECT {by}, (truth = predicted)::INT AS ok, row_number() OVER (PARTITION BY {by} ORDER BY doc_id) - 1 AS r,
        count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
sec AS (SELECT {by}, (r * 10 + 9) // n AS approx, r, n, ok FROM pos),
sect AS (SELECT {by}, list_max(list_filter(range(10), lambda i: (i * n) // 10 <= r)) AS section, ok FROM sec),
secm AS (SELECT {by}, section, avg(ok) AS a FROM sect GROUP BY ALL),
acc AS (SELECT {by}, avg(a) AS accuracy, stddev_pop(a) AS std FROM secm GROUP BY ALL),
result AS (SELECT * FROM sc JOIN acc USING ({by}))"""


METRICS = ["precision_weighted", "precision_micro", "precision_macro", "recall_weighted", "recall_micro",
           "recall_macro", "fmeasure_weighted", "fmeasure_micro", "fmeasure_macro", "cohens_kappa", "accuracy", "std"]
COMPARED = [m for m in METRICS if m != "std"]
ROUNDED = ", ".join(f"round({m}, 9) AS {m}" for m in METRICS)

_NEXT = "CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in q.NEXT_LABEL.items()) + " END"


def predictions(unlabelled: bool = False) -> str:
    truth = "CASE WHEN l.doc_id IS NOT NULL THEN lang ELSE 'UNL' END" if unlabelled else "lang"
    return f"""pipes AS (SELECT unnest(['p0', 'p1', 'p2']) AS pipeline_id, unnest([0, 1, 2]) AS pipeline_idx),
preds AS (SELECT d.doc_id, pipeline_id, pipeline_idx, {truth} AS truth,
    CASE WHEN substr(md5(concat(d.doc_id, '|', pipeline_id)), 1, 1) < 'a' THEN lang ELSE {_NEXT} END AS predicted
    FROM documents d LEFT JOIN labels l USING (doc_id) CROSS JOIN pipes)"""


FLAG = "CASE WHEN truth = 'UNL' THEN 'unlabeled' WHEN predicted = truth THEN 'correct' ELSE 'wrong' END"
MEMBERS = f"""members AS (SELECT string_agg(pipeline_id, ',' ORDER BY pipeline_idx) AS pipelines, predicted, doc_id,
    any_value({FLAG}) AS flag FROM preds GROUP BY predicted, doc_id)"""

EMB = """feats AS (SELECT vec_id AS doc_id, printf('e%02d', i - 1) AS feature, embedding[i]::DOUBLE AS value
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""

BASIC = f"""counts AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS nw,
    len(regexp_extract_all(text, '{SENTENCE}')) AS ns, len(regexp_extract_all(text, '[?]')) AS nq,
    len(regexp_extract_all(text, '!')) AS ne, len(regexp_extract_all(text, '{CURRENCY}')) AS nc,
    len(regexp_extract_all(text, '\\p{{Nd}}')) AS nd FROM docs),
basic AS (SELECT doc_id, CASE WHEN nw > 0 THEN nq / nw ELSE 0 END AS question_marks_perc,
    CASE WHEN nw > 0 THEN ne / nw ELSE 0 END AS exclamation_marks_perc,
    CASE WHEN nw > 0 THEN nc / nw ELSE 0 END AS currency_symbols_perc,
    CASE WHEN nw > 0 THEN nd / nw ELSE 0 END AS digits_perc, ns::DOUBLE AS sentences,
    CASE WHEN ns > 0 THEN nw / ns ELSE 0 END AS avg_sentence_length FROM counts)"""

TOKENS = f"""split AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM docs),
tagged AS (SELECT doc_id, word, substr(md5(word), 1, 1) AS c FROM split),
tokens AS (SELECT doc_id, word, CASE WHEN c < '8' THEN lower(word) ELSE word END AS lemma,
    CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'TW(hoofd)' WHEN c < '4' THEN 'WW(pv)' WHEN c < '8' THEN 'ADJ(prenom)'
         WHEN c < 'a' THEN 'BW()' WHEN c < 'd' THEN 'VNW(pers)' ELSE 'N(soort)' END AS pos,
    CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'B-PER' ELSE 'O' END AS ner FROM tagged)"""


def _share(category: str, listed) -> str:
    prefix, any_case, _ = CLASSES[category]
    words = ", ".join(f"'{w}'" for w in listed)
    test = f"{'lower(lemma)' if any_case else 'lemma'} IN ({words})"
    return test if prefix is None else f"pos LIKE '{prefix}%' AND {test}"


def _linguistic(lexicon) -> str:
    """CTEs nw, ling, linguistic; ``lexicon`` maps a category to its lemmas."""
    counts = {
        "adjectives_perc": "pos LIKE 'ADJ%'", "number_perc": "pos LIKE 'TW%'", "named_entities_perc": "ner LIKE 'B%'",
        **{name: _share(c, lexicon[c]) for c, (_, _, name) in CLASSES.items()},
    }
    return f"""nw AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n FROM docs),
ling AS (SELECT doc_id, {', '.join(f"count(*) FILTER ({c}) AS {n}" for n, c in counts.items())},
    count(DISTINCT CASE WHEN ner LIKE 'B%' THEN lower(lemma) END) AS unique_named_entities_perc
    FROM tokens GROUP BY doc_id),
linguistic AS (SELECT nw.doc_id, {', '.join(
    f"CASE WHEN n > 0 THEN coalesce({c}, 0) / n ELSE 0 END AS {c}" for c in LINGUISTIC_NAMES)}
    FROM nw LEFT JOIN ling USING (doc_id))"""


LINGUISTIC = _linguistic({c: words.split() for c, words in q.LEXICON.items()})


def _dutch() -> dict[str, list[str]]:
    with open(DUTCH_LEXICON, encoding="utf-8", newline="") as lines:
        rows = list(csv.DictReader(lines))
    return {c: [r["lemma"].replace("'", "''") for r in rows if r["category"] == c] for c in CLASSES}


SENTI = f"""lex(word, polarity, subjectivity) AS (VALUES {_values(q.SENTIMENT_ROWS)}),
lower_words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM docs),
means AS (SELECT doc_id, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity
          FROM lower_words JOIN lex USING (word) GROUP BY doc_id),
sentiment AS (SELECT d.doc_id, coalesce(polarity, 0) AS polarity, coalesce(subjectivity, 0) AS subjectivity
              FROM docs d LEFT JOIN means USING (doc_id))"""


# Quotes without look-ahead: a mark is set in front of whatever may not stand inside a quote, and a quote holds no mark.
# Cleaned texts hold no blank but the space.
_MARK = "\ue000"
_W = r"[\p{L}\p{M}\p{N}_]"
_STOP = f"„|‚‚|,,| [\"”''’]{_W}{_W}"
_QUOTED = (
    f"(?:„|‚‚|,,|\"|”|''|’)(?: {_W}|{_W}{_W}?)[^{_MARK}]{{0,1000}}?(?:\"|”|''|’)"
    f"(?:$|{_MARK}?[^{_W[1:-1]}{_MARK}])"
)
QUOTES = f"""marked AS (SELECT doc_id, label, text, regexp_replace(text, '({_STOP})', '{_MARK}\\1', 'g') AS m FROM docs),
quotes AS (SELECT doc_id, label, len(regexp_extract_all(m, '{_QUOTED}')) AS n_quotes,
    len(regexp_extract_all(text, '{SENTENCE}')) AS ns, replace(regexp_replace(m, '{_QUOTED}', '', 'g'), '{_MARK}', '') AS plain
    FROM marked),
quote AS (SELECT doc_id, CASE WHEN ns > 0 THEN n_quotes / ns ELSE 0 END AS {QUOTE_NAME} FROM quotes)"""


def _long(source: str, block: str, names) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{block}__{n}' AS feature, {n}::DOUBLE AS value FROM {source}" for n in names)


def _style() -> str:
    return " UNION ALL ".join([
        _long("basic", "Basic", BASIC_NAMES), _long("quote", "Quote", [QUOTE_NAME]),
        _long("sentiment", "Sentiment", ["polarity", "subjectivity"]), _long("linguistic", "Linguistic", LINGUISTIC_NAMES)])


def _style_bayes(with_terms: bool) -> str:
    """Naive Bayes over quartile-scaled, then min-max-scaled features; lexicon blocks and terms see no quotes."""
    plain = [part.replace("FROM docs", "FROM plain") for part in (_linguistic(_dutch()), SENTI)]
    words = f""" UNION ALL SELECT doc_id, 'TFIDF__' || term, w FROM
        (WITH {bags('plain')}, {tfidf(ALL_TRAIN)} SELECT doc_id, term, w FROM w)""" if with_terms else ""
    return f"""WITH {DOCS}, {QUOTES}, plain AS (SELECT doc_id, label, plain AS text FROM quotes),
        {BASIC}, {TOKENS}, {', '.join(plain)}, train AS ({ALL_TRAIN}), test AS ({ALL_TRAIN}),
        sizes AS (SELECT v, count(*) AS n FROM train GROUP BY v),
        w AS (SELECT 0 AS v, doc_id, feature AS term, value AS w FROM ({_style()}{words})),
        idfs AS (SELECT v, term, count(*) AS df FROM w GROUP BY v, term), {SCALED},
        span AS (SELECT v, term, CASE WHEN count(*) < any_value(n) THEN least(min(ws.w), 0) ELSE min(ws.w) END AS low,
            CASE WHEN count(*) < any_value(n) THEN greatest(max(ws.w), 0) ELSE max(ws.w) END AS high
            FROM ws JOIN sizes USING (v) GROUP BY v, term),
        xs AS (SELECT v, doc_id, term, (ws.w - low) / CASE WHEN high > low THEN high - low ELSE 1 END AS w
            FROM ws JOIN span USING (v, term)), {bayes('xs')}
        SELECT doc_id, predicted FROM best"""


_STOPS = ", ".join(f"'{w}'" for w in q.STOP_WORDS)
_PART = r"[\p{L}\p{M}\p{N}_]+\s*|[^\p{L}\p{M}\p{N}_]+"
_WORDS = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"


def statements() -> dict[str, str]:
    preds = predictions()
    preds_unl = predictions(True)
    sentences = f"list_transform(regexp_extract_all(text, '{SENTENCE}'), lambda s: s)"
    out = {
        "clean_ocr": f"WITH {DOCS} SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS n FROM docs",
        "style_basic": f"WITH {DOCS}, {BASIC} SELECT doc_id, "
        + ", ".join(f"round({c}, 9) AS {c}" for c in BASIC_NAMES) + " FROM basic",
        "quote_ratio": f"WITH {DOCS}, {QUOTES} SELECT * FROM quote",
        "remove_quotes": f"WITH {DOCS}, {QUOTES} SELECT doc_id, n_quotes::INT AS n_quotes, md5(plain) AS digest FROM quotes",
        "style_vector": f"""WITH {DOCS}, {QUOTES}, {BASIC}, {SENTI}, {TOKENS}, {LINGUISTIC}
            SELECT doc_id, feature, round(value, 9) AS value FROM ({_style()})""",
        "style_bayes_predict": _style_bayes(False),
        "combined_bayes_predict": _style_bayes(True),
        "stop_words": f"""WITH {DOCS} SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(text, '{_PART}'),
            lambda p: lower(rtrim(p)) NOT IN ({_STOPS})), '')) AS digest FROM docs""",
        "lowercase": f"WITH {DOCS} SELECT doc_id, md5(lower(text)) AS digest FROM docs",
        "sentence_split": f"""WITH {DOCS}, s AS (SELECT doc_id, {sentences} AS l FROM docs)
            SELECT doc_id, (i - 1)::BIGINT AS pos, trim(l[i]) AS sentence
            FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)""",
        **_stems_and_abbreviations(),
        "long_sentences": f"""WITH {DOCS}, s AS (SELECT doc_id, {sentences} AS l FROM docs),
            one AS (SELECT doc_id, i, string_split(l[i], ' ') AS t
                    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
            parts AS (SELECT doc_id, i, t, unnest(range(0, len(t), 10)) AS o FROM one)
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, o) - 1)::BIGINT AS pos,
                array_to_string(t[o + 1 : o + 10], ' ') || CASE WHEN o + 10 < len(t) THEN '.' ELSE '' END AS chunk FROM parts""",
        "character_frequency": """SELECT character, count(*) AS n FROM
            (SELECT unnest(regexp_extract_all(text, '(?s).')) AS character FROM documents) GROUP BY character""",
        "normalise_text": f"""WITH {DOCS} SELECT doc_id, md5(coalesce(array_to_string(list_transform(
            regexp_extract_all(text, '{_WORDS}'), lambda p: CASE WHEN regexp_matches(lower(p), '^[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}$')
            AND regexp_matches(lower(p), '(tion|ung|ment)$') THEN regexp_replace(lower(p), '(tion|ung|ment)$', '') ELSE p END), ''), ''))
            AS digest FROM docs""",
        "labelled_line_parse": f"""WITH {DOCS} SELECT d.doc_id, label,
            strftime(make_date((d.doc_id % 40 + 1950)::INT, (d.doc_id % 12 + 1)::INT, (d.doc_id % 28 + 1)::INT), '%Y-%m-%d') AS date,
            (d.doc_id % 40 + 1950)::INT AS year, s.source AS newspaper, (d.doc_id % 30)::INT AS page,
            concat('http://a/', d.doc_id, '|http://b/', d.doc_id) AS urls,
            md5(regexp_replace(text, '^(?:[0-9A-Za-z_]*=\\S* )+', '')) AS digest
            FROM docs d JOIN (SELECT doc_id, source FROM documents) s USING (doc_id) WHERE text <> ''""",
        "label_dictionary": """SELECT row_number() OVER (ORDER BY lang) - 1 AS label_idx, lang AS label
            FROM (SELECT DISTINCT lang FROM documents)""",
        "label_encode": """SELECT doc_id, lang AS label, dense_rank() OVER (ORDER BY lang) - 1 AS label_idx FROM documents""",
        "label_decode": "SELECT doc_id, lang AS label FROM documents",
        "label_by_year": """SELECT coalesce(year(o_orderdate)::VARCHAR, 'None') AS year, o_orderpriority AS label,
            count(*) AS size FROM orders GROUP BY ALL""",
        "label_by_year_events": """SELECT coalesce(year(ts)::VARCHAR, 'None') AS year, event_type AS label,
            count(*) AS size FROM events GROUP BY ALL""",
        "corpus_size": "SELECT count(*) AS n_articles FROM documents",
        "duplicate_texts": """SELECT count(*) AS n_articles, (count(*) - count(DISTINCT sha1(text)))::BIGINT AS n_duplicates
            FROM documents""",
        "kfold": f"WITH {DOCS}, {FOLDS} SELECT doc_id, fold FROM folds",
        "stratified_kfold": """SELECT doc_id, lang AS label, ntile(5) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS fold
            FROM documents""",
        "holdout_split": """SELECT doc_id, (row_number() OVER (ORDER BY md5(concat(doc_id, '|42')))
            <= ceil(0.2 * count(*) OVER ()))::INT AS is_test FROM documents""",
        "term_df": f"WITH {DOCS}, {bags()} SELECT term, count(*) AS df FROM bags GROUP BY term HAVING count(*) >= 5",
        "tfidf_weights": f"WITH {DOCS}, {bags()}, {tfidf(ALL_TRAIN)} SELECT doc_id, term, round(w, 6) AS w FROM w",
        "tfidf_scaled": f"""WITH {DOCS}, {bags()}, {tfidf(ALL_TRAIN)}, {SCALED}
            SELECT doc_id, term AS feature, round(w, 6) AS value FROM ws""",
        "chi2_select": f"""WITH {DOCS}, {bags()}, {tfidf(ALL_TRAIN)},
            share AS (SELECT label, count(*) / (SELECT count(*) FROM docs) AS p FROM docs GROUP BY label),
            tot AS (SELECT term, sum(w) AS t FROM w GROUP BY term),
            obs AS (SELECT term, label, sum(w) AS o FROM w JOIN docs USING (doc_id) GROUP BY ALL),
            c AS (SELECT tot.term, sum(power(coalesce(o, 0) - t * p, 2) / (t * p)) AS chi2 FROM tot CROSS JOIN share
                  LEFT JOIN obs ON obs.term = tot.term AND obs.label = share.label GROUP BY tot.term)
            SELECT term, round(chi2, 6) AS chi2 FROM c ORDER BY round(chi2, 6) DESC, term LIMIT 100""",
        "robust_scale": f"""WITH {EMB}, r AS (SELECT feature, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
            FROM feats GROUP BY feature)
            SELECT doc_id, feature, round(value / CASE WHEN iqr > 0 THEN iqr ELSE 1 END, 6) AS value FROM feats JOIN r USING (feature)""",
        "minmax_scale": f"""WITH {EMB}, r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM feats GROUP BY feature)
            SELECT doc_id, feature, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS value
            FROM feats JOIN r USING (feature)""",
        "sentiment": f"""WITH {DOCS}, {SENTI} SELECT doc_id, round(polarity, 9) AS polarity,
            round(subjectivity, 9) AS subjectivity FROM sentiment""",
        "linguistic": f"WITH {DOCS}, {TOKENS}, {LINGUISTIC} SELECT doc_id, "
        + ", ".join(f"round({c}, 9) AS {c}" for c in LINGUISTIC_NAMES) + " FROM linguistic",
        "entity_frequency": f"WITH {DOCS}, {TOKENS} SELECT lemma AS entity, count(*) AS n FROM tokens WHERE ner LIKE 'B%' GROUP BY lemma",
        "maximal_entities": f"""WITH {DOCS}, {TOKENS},
            e AS (SELECT doc_id, list(DISTINCT lower(lemma)) AS l FROM tokens WHERE ner LIKE 'B%' GROUP BY doc_id),
            m AS (SELECT doc_id, list_sort(l) AS l,
                  list_filter(list_sort(l), lambda x: len(list_filter(l, lambda y: contains(y, x))) = 1) AS top FROM e)
            SELECT doc_id, len(l) AS n_entities, array_to_string(top, '|') AS maximal,
                   array_to_string(list_filter(l, lambda x: NOT list_contains(top, x)), '|') AS contained FROM m""",
        "feature_union": f"""WITH {DOCS}, {BASIC}, {bags()}, {tfidf(ALL_TRAIN)},
            u AS ({_long('basic', 'Basic', BASIC_NAMES)} UNION ALL SELECT doc_id, 'TFIDF__' || term, w FROM w)
            SELECT doc_id, feature, round(value, 6) AS value FROM u""",
        "cache_misses": """SELECT DISTINCT sha1(text) AS sha FROM documents WHERE sha1(text) NOT IN
            (SELECT sha1(text) FROM documents JOIN labels USING (doc_id))""",
        "cache_hits": """SELECT doc_id, sha1(text) AS sha FROM documents WHERE sha1(text) IN
            (SELECT sha1(text) FROM documents JOIN labels USING (doc_id))""",
        "nb_predict": f"{_full()} SELECT doc_id, label, predicted FROM best JOIN docs USING (doc_id)",
        "nb_scaled_predict": f"""{_full('ws')} SELECT b.doc_id, predicted, round(s.score, 4) AS score_0 FROM best b
            JOIN scores s ON s.doc_id = b.doc_id AND s.label = (SELECT min(label) FROM lab)""",
        "nb_proba": f"""{_full()}, e AS (SELECT doc_id, label, exp(score - max(score) OVER (PARTITION BY doc_id)) AS x FROM scores),
            p AS (SELECT doc_id, label, x / sum(x) OVER (PARTITION BY doc_id) AS p FROM e)
            SELECT doc_id, {', '.join(f"round(max(p) FILTER (label = '{n}'), 6) AS p_{n}" for n in sorted(q.NEXT_LABEL))}
            FROM p GROUP BY doc_id""",
        "nb_cv_predictions": f"{_cv()} SELECT doc_id, fold, truth, predicted FROM preds",
        "nb_cv_scaled": f"{_cv('ws')} SELECT doc_id, fold, truth, predicted FROM preds",
        "nb_cv_metrics": f"{_cv()}, one AS (SELECT 0 AS g, * FROM preds), {metrics('one', 'g')} SELECT {ROUNDED} FROM result",
        "nb_quality_predict": f"""WITH {DOCS}, known AS (SELECT doc_id, quality::VARCHAR AS label FROM labels SEMI JOIN docs USING (doc_id)),
            {bags()}, {tfidf('SELECT 0 AS v, doc_id FROM known')}, test AS (SELECT 0 AS v, doc_id FROM docs),
            {bayes('w', '0.1', 'known')} SELECT doc_id, predicted FROM best""",
        "bulk_score": f"""{_full()} SELECT doc_id::VARCHAR AS id, (doc_id % 40 + 1950)::VARCHAR AS date, predicted AS label FROM best""",
        "confusion": f"""WITH {preds}, l AS (SELECT DISTINCT lang FROM documents)
            SELECT pipes.pipeline_id, a.lang AS truth, b.lang AS predicted, count(preds.doc_id) AS n
            FROM pipes CROSS JOIN l a CROSS JOIN l b LEFT JOIN preds ON preds.pipeline_id = pipes.pipeline_id
            AND preds.truth = a.lang AND preds.predicted = b.lang GROUP BY ALL""",
        "class_support": f"WITH {preds} SELECT pipeline_id, truth, count(*) AS support FROM preds GROUP BY ALL",
        "pipeline_metrics": f"WITH {preds}, {metrics('preds')} SELECT pipeline_id, {ROUNDED} FROM result",
        "percent_scores": f"WITH {preds}, {metrics('preds')} SELECT pipeline_id, " + ", ".join(
            f"printf('%.2f', trunc(round({m} * 10000, 8)) / 100.0) AS {m}" for m in METRICS) + " FROM result",
        "metric_compare": f"WITH {preds}, {metrics('preds')} " + " UNION ALL ".join(
            f"SELECT pipeline_id, '{m}' AS metric, round({m}, 9) AS value FROM result" for m in COMPARED),
        "accuracy": f"WITH {preds} SELECT pipeline_id, round(avg((truth = predicted)::INT), 9) AS accuracy FROM preds GROUP BY ALL",
        "comparison_long": f"WITH {preds_unl} SELECT doc_id, pipeline_id, predicted, truth, {FLAG} AS flag FROM preds",
        "comparison_wide": f"WITH {preds} SELECT doc_id, truth, " + ", ".join(
            f"max(predicted) FILTER (pipeline_id = '{p}') AS {p}" for p in q.PIPELINES) + " FROM preds GROUP BY ALL",
        "agreement_members": f"WITH {preds_unl}, {MEMBERS} SELECT pipelines, predicted, doc_id, flag FROM members",
        "agreement_sets": f"""WITH {preds_unl}, {MEMBERS} SELECT pipelines, predicted, count(*) AS n_articles,
            count(*) FILTER (flag = 'correct') AS n_correct, count(*) FILTER (flag = 'wrong') AS n_wrong,
            count(*) FILTER (flag = 'unlabeled') AS n_unlabeled FROM members GROUP BY ALL""",
        "majority_vote": f"""WITH {preds_unl}, v AS (SELECT doc_id, predicted AS prevailing,
            string_agg(pipeline_id, ',' ORDER BY pipeline_idx) AS voters, count(*) AS n_votes, any_value(truth) AS truth,
            min(pipeline_idx) AS first_idx FROM preds GROUP BY doc_id, predicted)
            SELECT doc_id, prevailing, voters, n_votes, truth FROM v
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_votes DESC, first_idx) = 1""",
    }
    out["confusion_norm"] = f"""WITH c AS ({out['confusion']}) SELECT pipeline_id, truth, predicted,
        round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END, 9) AS share FROM c
        WINDOW w AS (PARTITION BY pipeline_id, truth)"""
    out["nb_grid"] = _grid()
    out["nb_grid_top"] = f"SELECT * FROM ({_grid()}) WHERE rank <= 3"
    out |= _sources(out)
    out["class_pairs"] = """WITH l AS (SELECT DISTINCT label::VARCHAR AS label, label AS n FROM embeddings)
        SELECT row_number() OVER (ORDER BY a.n, b.n) - 1 AS pair, a.label AS first, b.label AS second
        FROM l a JOIN l b ON a.n < b.n"""
    return out


def _stems_and_abbreviations() -> dict[str, str]:
    docs = f"""{DOCS}, short AS (SELECT doc_id, replace(replace(text, ' the ', ' nr. '), ' la ', ' s.v. ') AS text FROM docs)"""
    learned = r"""tokens AS (SELECT unnest(string_split(text, ' ')) AS t FROM short),
        types AS (SELECT lower(rtrim(t, '.')) AS type, count(*) AS n, sum((t LIKE '%.')::INT)::BIGINT AS n_stop
          FROM tokens WHERE regexp_matches(t, '^\p{L}+(\.\p{L}+)*\.?$') GROUP BY 1),
        p AS (SELECT sum(n_stop)::DOUBLE / sum(n) AS p FROM types),
        parts AS (SELECT types.*, n - n_stop AS rest, length(replace(type, '.', ''))::DOUBLE AS letters, p FROM types, p),
        abbreviations AS (SELECT type, n, n_stop, -2 * ((n_stop * ln(p) + rest * ln(1 - p)) - (n_stop * ln(0.99) + rest * ln(1 - 0.99)))
          * exp(-letters) * (length(type) - letters + 1) * pow(letters, -rest::DOUBLE) AS score FROM parts),
        learned AS (SELECT * FROM abbreviations WHERE score >= 0.3 AND n_stop > 0)"""
    joined = "list_transform({s}, lambda b, n: array_to_string(list_slice({p}, b + 1, coalesce({s}[n + 1], len({p}))), ''))"
    v, c = "[aeiouyè]", "[^aeiouyè]"
    cut = lambda w, n: f"left({w}, length({w}) - {n})"
    undouble = lambda w: f"CASE WHEN regexp_matches({w}, '(kk|dd|tt)$') THEN {cut(w, 1)} ELSE {w} END"
    inside = lambda w, n, r: f"length({w}) - {n} >= {r}"
    en = lambda w, n: f"({inside(w, n, 'p1')} AND regexp_matches({cut(w, n)}, '{c}$') AND {cut(w, n)} NOT LIKE '%gem')"
    s_end = lambda n: f"({inside('w', n, 'p1')} AND regexp_matches({cut('w', n)}, '[^aeiouyèj]$'))"
    e_end = lambda w: f"({w} LIKE '%e' AND {inside(w, 1, 'p1')} AND regexp_matches({cut(w, 1)}, '{c}$'))"
    ig = lambda w: f"({w} LIKE '%ig' AND {inside(w, 2, 'p2')} AND {w} NOT LIKE '%eig')"
    three, four = cut("w", 3), cut("w", 4)
    vowels = "w"
    for x in "aeou":
        vowels = f"regexp_replace({vowels}, '({c}){x}{x}([^aeiouyèI])$', '\\1{x}\\2')"
    stems = f"""WITH {DOCS}, words AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM docs),
        counted AS (SELECT word, count(*) AS n, regexp_replace(regexp_replace(regexp_replace(translate(word, 'äáëéïíöóüú', 'aaeeiioouu'),
          '^y', 'Y'), '({v})y', '\\1Y', 'g'), '({v})i({v})', '\\1I\\2', 'g') AS w FROM words GROUP BY word),
        found AS (SELECT *, length(regexp_extract(w, '^.*?{v}{c}')) AS f, length(regexp_extract(w, '^.*?{v}{c}.*?{v}{c}')) AS b FROM counted),
        regions AS (SELECT word, n, w, CASE WHEN f > 0 THEN greatest(f, 3) ELSE length(w) END AS p1,
          CASE WHEN b > 0 THEN b ELSE length(w) END AS p2 FROM found),
        one AS (SELECT word, n, p1, p2, CASE
          WHEN w LIKE '%heden' THEN CASE WHEN {inside('w', 5, 'p1')} THEN {cut('w', 5)} || 'heid' ELSE w END
          WHEN w LIKE '%ene' THEN CASE WHEN {en('w', 3)} THEN {undouble(cut('w', 3))} ELSE w END
          WHEN w LIKE '%en' THEN CASE WHEN {en('w', 2)} THEN {undouble(cut('w', 2))} ELSE w END
          WHEN w LIKE '%se' THEN CASE WHEN {s_end(2)} THEN {cut('w', 2)} ELSE w END
          WHEN w LIKE '%s' THEN CASE WHEN {s_end(1)} THEN {cut('w', 1)} ELSE w END ELSE w END AS w FROM regions),
        two AS (SELECT word, n, p1, p2, {e_end('w')} AS e, CASE WHEN {e_end('w')} THEN {undouble(cut('w', 1))} ELSE w END AS w FROM one),
        three AS (SELECT word, n, p1, p2, e, w LIKE '%heid' AND {inside('w', 4, 'p2')} AND w NOT LIKE '%cheid' AS h, w FROM two),
        cut3 AS (SELECT word, n, p1, p2, e, h, CASE WHEN h THEN {cut('w', 4)} ELSE w END AS w FROM three),
        en3 AS (SELECT word, n, p1, p2, e, CASE WHEN h AND w LIKE '%en' AND {en('w', 2)} THEN {undouble(cut('w', 2))} ELSE w END AS w FROM cut3),
        four AS (SELECT word, n, CASE
          WHEN w LIKE '%end' OR w LIKE '%ing' THEN CASE WHEN {inside('w', 3, 'p2')} THEN CASE WHEN {ig(three)} THEN {cut(three, 2)}
            ELSE {undouble(three)} END ELSE w END
          WHEN w LIKE '%ig' THEN CASE WHEN {ig('w')} THEN {cut('w', 2)} ELSE w END
          WHEN w LIKE '%lijk' THEN CASE WHEN {inside('w', 4, 'p2')} THEN CASE WHEN {e_end(four)} THEN {undouble(cut(four, 1))}
            ELSE {four} END ELSE w END
          WHEN w LIKE '%baar' THEN CASE WHEN {inside('w', 4, 'p2')} THEN {four} ELSE w END
          WHEN w LIKE '%bar' THEN CASE WHEN {inside('w', 3, 'p2')} AND e THEN {three} ELSE w END ELSE w END AS w FROM en3)
        SELECT word, n, lower({vowels}) AS stem FROM four"""
    starts = "list_filter(range(0, len({p})), lambda i: i = 0 OR {begins})"
    inner = starts.format(p="p", begins="p[i + 1] LIKE ' %'")
    outer = starts.format(p="q", begins="NOT (q[i] LIKE '%.' AND list_contains(a, lower(regexp_extract(q[i], '([^ ]*)\\.$', 1))))")
    return {
        "abbreviation_list": f"WITH {docs}, {learned} SELECT type, n, n_stop, round(score, 6) AS score FROM learned",
        "abbreviation_sentences": f"""WITH {docs}, {learned}, known AS (SELECT coalesce(list(type), []) AS a FROM learned),
            pieces AS (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS p FROM short),
            first AS (SELECT doc_id, p, {inner} AS s FROM pieces),
            whole AS (SELECT doc_id, {joined.format(s="s", p="p")} AS q FROM first),
            second AS (SELECT doc_id, q, {outer} AS s FROM whole, known)
            SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string({joined.format(s="s", p="q")}, '|')) AS digest FROM second""",
        "word_stems": stems,
    }


def _sources(known: dict[str, str]) -> dict[str, str]:
    """Sources, sinks, stores, and the checks of learners and explanations."""
    preds = " UNION ALL ".join(
        f"""SELECT b.doc_id, '{name}' AS pipeline_id, predicted, label AS truth
            FROM (WITH {bayes("w", repr(alpha))} SELECT * FROM best) b JOIN docs USING (doc_id)"""
        for name, alpha in (("nb_smooth", 1.0), ("nb", 0.1)))
    scored = f"""WITH {DOCS}, {bags()}, {tfidf(ALL_TRAIN)}, test AS (SELECT 0 AS v, doc_id FROM docs), preds AS ({preds})"""
    chosen = bayes("wk").replace("idfs", "kept")
    chi2_cv = f"""WITH {DOCS}, {FOLDS.replace('ntile(10)', 'ntile(3)')}, {bags()}, {tfidf(FOLD_TRAIN.format(k=3))},
        test AS (SELECT fold AS v, doc_id FROM folds),
        shares AS (SELECT v, label, count(*)::DOUBLE / any_value(n) AS share FROM train JOIN docs USING (doc_id) JOIN sizes USING (v)
          GROUP BY v, label),
        seen AS (SELECT v, term, label, sum(w.w) AS o FROM w JOIN train USING (v, doc_id) JOIN docs USING (doc_id) GROUP BY v, term, label),
        whole AS (SELECT v, term, sum(o) AS t FROM seen GROUP BY v, term),
        chi AS (SELECT whole.v, whole.term, round(sum(power(coalesce(o, 0) - t * share, 2) / (t * share)), 6) AS c
          FROM whole JOIN shares USING (v) LEFT JOIN seen ON seen.v = whole.v AND seen.term = whole.term AND seen.label = shares.label
          GROUP BY whole.v, whole.term),
        kept AS (SELECT v, term FROM chi QUALIFY row_number() OVER (PARTITION BY v ORDER BY c DESC, 'TFIDF__' || term) <= 200),
        wk AS (SELECT w.* FROM w SEMI JOIN kept USING (v, term)), {chosen}
        SELECT doc_id, fold, label AS truth, predicted FROM best JOIN folds USING (doc_id)"""
    columns = ", ".join(f"(lang = '{c}')::INT::DOUBLE AS {c}" for c in ("de", "en", "es", "fr"))
    return {
        "lines_corpus": f"""WITH {DOCS} SELECT d.doc_id AS page, lang AS label, 1950 + d.doc_id % 40 AS year, source AS newspaper,
            2::BIGINT AS n_urls, md5(rtrim('text: ' || c.text)) AS digest FROM documents d JOIN docs c USING (doc_id)""",
        "line_numbers": "SELECT 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS n FROM documents",
        "strict_load": """SELECT count(*) FILTER (doc_id % 7 <> 3) AS n_good, count(*) FILTER (doc_id % 7 <> 3) AS n_strict,
            count(DISTINCT lang) FILTER (doc_id % 7 <> 3) AS n_labels, count(*) FILTER (doc_id % 7 = 3) AS n_bad,
            0::BIGINT AS n_none, true AS refused FROM documents""",
        "csv_corpus": """SELECT lang AS label, md5('"a", ' || text) AS digest, count(*) AS n FROM documents GROUP BY ALL""",
        "stop_word_source": "SELECT DISTINCT source AS word FROM documents",
        "prediction_sink": """SELECT doc_id::VARCHAR AS id, 'd' || (doc_id % 7) AS date, lang AS label, source AS newspaper,
            1950 + doc_id % 3 AS year FROM documents""",
        "corpus_store": "SELECT doc_id, lang AS label, md5(text) AS digest FROM documents WHERE lang = 'en'",
        "token_store": """SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> ''))::BIGINT AS n_tokens
            FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: w <> '')) > 0""",
        "annotation_store": f"""WITH {DOCS}, shas AS (SELECT doc_id, sha1(text) AS sha, text FROM docs),
            early AS (SELECT DISTINCT sha FROM shas WHERE doc_id % 2 = 0)
            SELECT doc_id, sha, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
              CASE WHEN sha IN (SELECT sha FROM early) THEN 'even' ELSE 'all' END AS writer FROM shas""",
        "chi2_bayes_cv": chi2_cv,
        "model_store": f"{_full()} SELECT doc_id, predicted FROM best",
        "score_pipelines": f"{scored} SELECT doc_id, pipeline_id, predicted, truth FROM preds",
        "score_metrics": f"{scored}, {metrics('preds')} SELECT pipeline_id, {ROUNDED} FROM result",
        "score_comparison": f"""{scored} SELECT pipeline_id, CASE WHEN predicted = truth THEN 'correct' ELSE 'wrong' END AS flag,
            count(*) AS n FROM preds GROUP BY ALL""",
        "selected_features": f"SELECT doc_id, digits_perc, sentences FROM ({known['style_basic']})",
        "dict_vectoriser": f"SELECT doc_id, {columns}, n_chars::DOUBLE AS n_chars FROM documents",
        "dict_keys": "SELECT DISTINCT lang AS feature FROM documents UNION SELECT 'n_chars'",
        "text_svm_checks": """SELECT count(*) AS n_rows, count(*) AS n_docs, count(*) AS n_sums, count(*) AS n_positive,
            count(*) AS n_labelled, true AS accurate, 0::BIGINT AS n_over, (count(DISTINCT lang) * (count(DISTINCT lang) - 1) / 2)::BIGINT AS n_pairs
            FROM documents""",
        "text_svm_cv_accuracy": """SELECT count(*) AS n_rows, count(*) AS n_docs, 10::BIGINT AS n_folds, true AS folds_right,
            true AS labels_right FROM documents""",
        "importance_checks": "SELECT 64::BIGINT AS n_features, 64::BIGINT AS n_names, true AS adds_up, true AS positive",
        "split_count_checks": """SELECT 64::BIGINT AS n_features, true AS all_nodes, true AS used_only, true AS all_used,
            true AS no_loss""",
        "planted_importance_checks": "SELECT 64::BIGINT AS n_features, true AS found",
        "kernel_error_checks": "SELECT count(*) AS n, true AS reached_or_all_taken, true AS holds FROM embeddings",
        "shap_linear_checks": "SELECT count(*) * 128 AS n_values, count(*) * 128 AS n_right FROM embeddings",
        "shap_checks": """SELECT n AS n_values, n AS n_exact, n AS n_full
            FROM (SELECT count(*) * count(DISTINCT label) AS n FROM embeddings)""",
        "lime_text_checks": "SELECT count(*) AS n_items, count(*) AS n_short, count(*) AS n_ranked, count(*) AS n_held FROM benchmark",
    }


def _grid() -> str:
    folds = "folds AS (SELECT doc_id, label, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS fold FROM docs)"
    parts = []
    for i, alpha in enumerate(q.ALPHAS):
        body = bayes("w", repr(max(alpha, 1e-10)))
        parts.append(f"""SELECT {i} AS candidate_id, {alpha}::DOUBLE AS alpha, fold, avg((predicted = label)::INT) AS score
            FROM (WITH {body} SELECT b.doc_id, predicted, label, fold FROM best b JOIN folds USING (doc_id)) GROUP BY fold""")
    return f"""WITH {DOCS}, {folds}, {bags()}, {tfidf(FOLD_TRAIN.format(k=5))},
        test AS (SELECT fold AS v, doc_id FROM folds), each AS ({' UNION ALL '.join(parts)}),
        g AS (SELECT candidate_id, alpha, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM each GROUP BY ALL)
        SELECT candidate_id::BIGINT AS candidate_id, alpha, round(mean_score, 9) AS mean_score,
        round(std_score, 9) AS std_score, rank() OVER (ORDER BY mean_score DESC) AS rank FROM g"""
