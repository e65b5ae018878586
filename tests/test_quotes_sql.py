"""The quote pattern against its SQL counterpart, which has no look-ahead, on made texts full of marks."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from pressmark.functions import text as tx
from pressmark.plans import oracle


def test_quotes_equal_their_sql(spark):
    rng = random.Random(7)
    parts = ["„", "‚‚", ",,", '"', "”", "'", "’", " ", " ", "a", "bc", "é9", "_", ",", ".", "woord ", " 'de", ' "x', "x" * 600]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    made += ['"Ja", zei hij. "Nee"', "„Dit is waar” en 'dat' ook", '"een "twee" drie"', ",,,ab\" ,,,,cd\"", '"a' + "b" * 1001 + '"', ""]
    docs = pd.DataFrame({"doc_id": range(len(made)), "label": "x", "text": made})
    con = duckdb.connect()
    con.register("docs", docs)
    want = con.sql(f"WITH {oracle.QUOTES} SELECT doc_id, n_quotes, plain FROM quotes ORDER BY doc_id").fetchall()
    t = F.col("text")
    got = spark.createDataFrame(docs).select("doc_id", tx.quote_count(t), tx.remove_quotes(t)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    assert sum(n for _, n, _ in want) > 1000
