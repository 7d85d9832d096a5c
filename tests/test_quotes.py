"""Quotes in documents against plain substring search."""

import random

from pyspark.sql import functions as F

from quoteproof.operators import grounding


def found(spark, docs, quotes):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    q = spark.createDataFrame(quotes, "item_id long, quote string")
    got = grounding.quoted_in(d, q, "doc_id", "item_id")
    assert sorted(got.columns) == ["doc_id", "item_id", "lang"]
    return got, sorted((r.doc_id, r.item_id) for r in got.collect())


def test_quotes_of_any_length(spark):
    rng = random.Random(4)
    syllables = ["ab", "ba", "c", "dö", "e", "😀", "ff", "日", "x" * 40]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 25))), "en") for k in range(200)] + [(900, None, "en"), (901, "", "de"), (902, "a" * 20000, "de"), (3, "abc", "fr")]
    quotes = [(k, " ".join(word() for _ in range(1 + k % 4))) for k in range(150)]
    for k in range(150):  # cut out of texts, so that they begin and end within words
        text = docs[rng.randint(0, 199)][1]
        at = rng.randint(0, max(0, len(text) - 12))
        quotes.append((1000 + k, " ".join(text[at : at + rng.randint(1, 12)].split())))
    quotes += [(2000, ""), (2001, "a"), (2002, "日"), (2007, "😀"), (2008, "😀a"), (2003, "nowhere at all"), (2004, "zz"), (2005, None), (2006, "c c"), (2006, "c c")]
    plan, got = found(spark, docs, quotes)
    want = {(d, i) for d, text, _ in docs for i, q in quotes if q and text is not None and q in text}
    assert set(got) == want
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()


def test_very_many_short_quotes(spark):
    """More one-word quotes than could be tried one by one."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort"), F.col("id") * 700, F.lit(" und mehr")).alias("text"))
    quotes = spark.range(200_000).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), F.col("id")).alias("quote"))
    got = {(r.doc_id, r.item_id) for r in grounding.quoted_in(docs, quotes, "doc_id", "item_id").collect()}
    want = {(d, int(str(d * 700)[:n])) for d in range(300) for n in range(1, len(str(d * 700)) + 1) if int(str(d * 700)[:n]) < 200_000}
    assert got == want


def test_long_quotes_alone_need_no_index_of_all_words(spark):
    """No character runs are looked at, and each text is cut into words for what quotes ask for only."""
    docs = spark.createDataFrame([(1, "eins zwei drei vier"), (2, "eins zwei"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "s zwei dr"), (8, "zwei fehlt vier")], "item_id long, quote string")
    found = grounding.quoted_in(docs, items, "doc_id", "item_id")
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 7)]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "_gram" not in plan and "explode" not in plan
