"""Typed values: accepted and refused spellings, folding, and canonical numerals against decimals."""

import random
import re
import unicodedata
from datetime import date
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quoteproof.functions import values as v
from quoteproof.functions.folding import casefolded, folded_each, folded_text
from quoteproof.functions.grammar import FOLDED


def each(spark, texts, *columns):
    """The columns' values for every text."""
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [tuple(r)[1:] for r in frame.select("k", *(c(F.col("t")) for c in columns)).orderBy("k").collect()]


def test_numbers(spark):
    spelled = {"1.250": "1250", "12,5": "12.5", "1 234,5": "1234.5", "1\u00a0234": "1234", "1234.5": "1234.5", "-3": "-3", "1.25": "1.25", " 007,50 ": "7.5", "-0,0": "0", "0": "0", "100": "100", "1.000.000,10": "1000000.1"}
    refused = ["abc", "1,2,3", "", "1.2.3", "1 2", "12.3456.7", "- 3", "1e5", "5\n6"]
    got = each(spark, [*spelled, *refused], v.numeral, v.number)
    assert [x[0] for x in got] == [*spelled.values(), *[None] * len(refused)]
    assert [x[1] for x in got[: len(spelled)]] == [Decimal(x) for x in spelled.values()]
    running = {"bis 1.250 Stk. und 12,5 kg (-3) a-7, 1.2.3 4,5": ["1250", "12.5", "-3", "7", "4.5"], "x 12.10.2026": [], "3,": ["3"], "5-7": ["5", "7"], "": [], "99999999999999999999999999999999999999999,5": ["99999999999999999999999999999999999999999.5"]}
    assert [x[0] for x in each(spark, list(running), v.numerals_in)] == list(running.values())


def test_numeral_of_any_decimal(spark):
    numbers = [Decimal(n) / 10**p for n in (0, 1, 5, 10, 1005, 123456, 99999, 1000000) for p in range(0, 5)]
    german = [f"{n:,.4f}".replace(",", " ").replace(".", ",") for n in numbers]  # blanks group, a comma divides
    got = each(spark, german, v.numeral)
    assert [Decimal(x[0]) for x in got] == numbers and all(x[0] == format(n.normalize(), "f") for x, n in zip(got, numbers, strict=True))


def fold_text(text):
    """The rule in plain Python, by its own Unicode tables."""
    plain = unicodedata.normalize("NFKC", text).replace("\u00ad", "")
    whole = re.sub(r"\w-[^\S\n]*\r?\n\s*\w", lambda m: m[0][0] + m[0][-1], plain)
    return " ".join(whole.translate(str.maketrans(FOLDED)).split()).casefold()


def test_folding(spark):
    told = {"Ge-\nrät  \u201eX\u201c 200×100": 'gerät "x" 200x100', "Gro\u00adß": "gross", "a- \r\n  b": "ab", "a -\nb": "a - b", "a-\nb-\nc": "ab- c", "ｍｍ ㎏ Ⅳ": "mm kg iv", "İ": "i̇", "a—b−c": "a-b-c", "": ""}
    got = each(spark, [*told, None], folded_text, casefolded)
    assert [x[0] for x in got] == [*told.values(), None] and got[-1] == (None, None)
    lists = [["Ge-\nrät ", None, " ｍｍ", "a\x01b", ""], [], None]
    frame = spark.createDataFrame(list(enumerate(lists)), "k int, x array<string>")
    assert [r.f for r in frame.select("k", folded_each(F.col("x")).alias("f")).orderBy("k").collect()] == [["gerät", "mm", "a\ufffdb", ""], [], None]


def test_folding_of_every_character(spark):
    """All assigned code points of the basic plane, and random sequences of them, without a Python worker."""
    known = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rng = random.Random(2)
    odd = ["-\n", "- \r\n ", "\u0301", "\u00ad", "ß", "ﬁ", "İ", "\u0345", "ς", "x"]
    texts = known + ["".join(rng.choice(known if rng.random() < 0.7 else odd) for _ in range(rng.randint(2, 9))) for _ in range(100_000)]
    # letters newer than the JVM's own tables are no letters for its patterns
    table = spark.createDataFrame(pa.table({"t": texts})).where(~F.col("t").rlike(r"\p{Cn}"))
    folded = table.select("t", folded_text(F.col("t")).alias("f"))
    assert table.count() > 150_000
    wrong = [(t, f) for t, f in zip(*folded.toArrow().to_pydict().values(), strict=True) if f != fold_text(t)]
    assert wrong == []
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()


def test_dates_weeks_units(spark):
    days = {"3.4.26": date(2026, 4, 3), "31.2.2026": None, "2026-02-28": date(2026, 2, 28), " 01.12.2026 ": date(2026, 12, 1), "1.1.202": None, "0000-01-01": None, "1.2.2026 x": None}
    assert dict(zip(days, (x[0] for x in each(spark, list(days), v.day)), strict=True)) == days
    running = {"bis 2026-11-01 oder 12.10.2026.": [date(2026, 11, 1), date(2026, 10, 12)], "1.2.2026-3 3.2.26": [date(2026, 2, 3)], "v1.2.20260": [], "30.02.2026, 1.3.2026": [date(2026, 3, 1)]}
    assert dict(zip(running, (x[0] for x in each(spark, list(running), v.days_in)), strict=True)) == running
    weeks = {"KW 42/2026, Kalenderwoche 7 und CW60": [(42, 2026), (7, None)], "KW60 kw. 5 / 26": [(5, 2026)], "KW 42 2026": [(42, 2026)], "KW 42 1926": [(42, None)], "skw 4, KW 123": []}
    assert {t: [tuple(w) for w in x[0]] for t, x in zip(weeks, each(spark, list(weeks), v.weeks_in), strict=True)} == weeks
    units = {" Stk. ": "pcs", "m²": None, "STÜCK": "pcs", "kg..": None, "Tonnen": "t", "": None}
    assert dict(zip(units, (x[0] for x in each(spark, list(units), v.unit)), strict=True)) == units


CHECKS = [  # kind, value, quote, what the check gives (None: refused)
    ("text", " Werk  Ost ", "an werk ost geliefert", "Werk  Ost"), ("text", "Ost", "Kosten", None), ("text", "G", "GmbH", None), ("text", "", "x", None), ("text", "a.b", "a.b c", "a.b"), ("text", "a.b", "axb", None),
    ("text", "\\E.*", "x \\E.* y", "\\E.*"), ("text", "Straße", "STRASSE 5", "Straße"), ("text", "²", "m²", None), ("text", "\u0301", "a \u0301 b", "\u0301"),
    ("number", "1250", "1.250 Stk.", "1250"), ("number", "12", "112", None), ("number", "2,50", "zu 2,5 m", "2.5"), ("number", "x", "x", None),
    ("unit", "pcs", "60 | Stk.", "pcs"), ("unit", "t", "St 37-2", None), ("unit", "m", "5 m²", None), ("unit", "mm", "200 x 100mm", "mm"), ("unit", "kg", "60 | Stk. | 12 | kg", None), ("unit", "Rolle", "2 Rolle", "Rolle"),
    ("unit", "Stück", "Stück\t5", "pcs"), ("unit", "kg", "5 ㎏", None), ("unit", "kg", "5 | ㎏", "kg"), ("unit", "m", "5 m.", "m"), ("unit", "m", "5 mx", None),
    ("email", "A@b.de", "mail a@B.de.", "a@b.de"), ("email", "a@b.de", "xa@b.de", None), ("email", "a@b.de", "a@b.dex", None), ("email", "a@b", "a@b", None), ("email", "a@straße.de", "A@STRASSE.DE", None),
    ("phone", "+49 30 1234567", "Tel. +49 30 1234567", "+49 30 1234567"), ("phone", "12.10.2026", "12.10.2026", None), ("phone", "030/12-34567", "(030) 1234567", "030/12-34567"), ("phone", "12345", "12345", None), ("phone", "49301234567", "+49301234567", None),
    ("date", "1.2.2026", "2026-02-01", "2026-02-01"), ("date", "KW 42", "Termin KW 42/2026", "KW 42"), ("date", "KW 42/2026", "KW 42", None), ("date", "cw 7 2026", "Kalenderwoche 7/26", "KW 7/2026"), ("date", "2.2.2026", "1.2.2026", None), ("date", "bald", "bald", None),
    (None, "Werk", "das Werk", "Werk"),
]


def checks(spark, rows):
    kind, value, quote = F.col("kind"), F.col("value"), F.col("quote")
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kind string, value string, quote string")
    folded = frame.select("k", "kind", "value", "quote", folded_text(value).alias("v"), folded_text(quote).alias("q"), folded_each(v.unit_pieces(value, quote)).alias("p"), casefolded(quote).alias("f"))
    return [r.c for r in folded.select("k", v.check(kind, value, quote, *(F.col(c) for c in "vqpf")).alias("c")).orderBy("k").collect()]


def test_checks(spark):
    got = checks(spark, [r[:3] for r in CHECKS])
    wrong = [(r, c) for r, c in zip(CHECKS, got, strict=True) if (c.normalized if c.ok else None) != r[3] or c.ok != (r[3] is not None)]
    assert not wrong
    one, two, same = checks(spark, [("date", "1.2.2026", "1.2.2026 oder 3.2.2026"), ("date", "KW 4", "KW 4"), ("date", "1.2.2026", "1.2.2026 = 2026-02-01")])
    assert one.ambiguous and not two.ambiguous and two.calendar_week and not same.ambiguous


@pytest.mark.parametrize("text", ["\\E", "a\\Eb\\Q", "\\Q\\E", "$1", "a\\"])
def test_quoted_matches_itself(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(F.regexp_like("t", F.concat(F.lit("^"), v.quoted(F.col("t")), F.lit("$")))).first()[0]


def test_each_part_of_a_check_is_evaluated_once(spark):
    """A check's tree grows with its rules, not with how often a rule names what it looks at."""
    row = spark.createDataFrame([("date", "x")], "kind string, value string")
    tree = row.select(v.check(F.col("kind"), *[F.col("value")] * 4, F.array("value"), F.col("value")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert tree.count("regexp_") <= 40, tree.count("regexp_")


def test_usual_texts_fold_as_the_library_folds_them(spark):
    texts = ["Straße ÄÖÜ àÿ", " Zwei  Blanks ", "AB-\nCD", "a\tb", "\x01 A \x01", "ĳ ﬁ İ", "\x7f\x1f X", "", "ÞÐ × ÷ µ ª", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    # a character at the end that no folding changes sends every text the long way
    got = frame.select("k", folded_text(F.col("t")).alias("f"), folded_text(F.concat("t", F.lit("。"))).alias("long"), casefolded(F.col("t")).alias("c"), casefolded(F.concat("t", F.lit("。"))).alias("long_c")).orderBy("k").collect()
    assert [r.f for r in got] == [None if r.long is None else r.long[:-1].rstrip(" ") for r in got]
    assert [r.c for r in got] == [None if r.long_c is None else r.long_c[:-1] for r in got]
