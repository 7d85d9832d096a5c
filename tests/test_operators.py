"""Verification rules row by row, lifecycle, streaming and plans."""

import pytest
from pyspark.sql import functions as F

from quoteproof.operators import grounding, intake
from quoteproof.schema import CLAIMS, SEGMENTS
from quoteproof.streaming import wrappers

RULES = [  # value, claimed, segment, quote -> status, reason
    ("x", "missing", "s1", "x", "unverified", "missing_with_value"), (None, "missing", "s1", "x", "missing", None), ("x", "found", None, None, "unverified", "no_evidence"),
    ("x", "uncertain", None, None, "uncertain", None), (None, "found", "s1", "Werk", "unverified", "no_value"), ("Werk", "found", "s9", "Werk", "unverified", "unknown_segment"),
    ("Werk", "found", "s1", " ", "unverified", "empty_quote"), ("Werk", "found", "s1", "fremd", "unverified", "quote_not_in_segment"), ("Ost", "found", "s1", "Werk", "unverified", "value_not_in_quote"),
    ("Werk", "found", "s2", "Werk", "uncertain", "ocr_only"), ("Werk", "found", "s1", "Werk", "found", None), ("Werk", "uncertain", "s1", "Werk", "uncertain", None), (None, "uncertain", "s1", "Werk", "uncertain", None),
]


def test_rules(spark):
    segments = spark.createDataFrame([("d", "s1", 0, "Das Werk Ost", None, None, 1, False), ("d", "s2", 1, "Das Werk", None, None, 2, True)], SEGMENTS)
    claims = spark.createDataFrame([("d", "company", k, r[0], r[1], r[2], r[3]) for k, r in enumerate(RULES)], CLAIMS)
    got = {r.item_index: (r.status, r.reason) for r in grounding.verify(claims, segments).collect()}
    assert [got[k] for k in range(len(RULES))] == [r[4:] for r in RULES]
    dated = spark.createDataFrame([("d", "s1", 0, "KW 7 oder 1.2.2026 und 2.2.2026", None, None, 1, False)], SEGMENTS)
    asks = spark.createDataFrame([("d", "requested_delivery_date", 0, "KW 7", "found", "s1", "KW 7"), ("d", "requested_delivery_date", 1, "1.2.2026", "found", "s1", "1.2.2026 und 2.2.2026")], CLAIMS)
    got = {r.item_index: (r.status, r.reason, r.value) for r in grounding.verify(asks, dated).collect()}
    assert got == {0: ("uncertain", "calendar_week_only", "KW 7"), 1: ("uncertain", "ambiguous_quote", "2026-02-01")}
    fields = grounding.verify(claims, segments)
    assert [r.document_id for r in grounding.rejected_documents(fields, segments).collect()] == ["d"]


def test_fold_and_ledger(spark):
    rows = spark.createDataFrame([("a", 1, "processing.started"), ("a", 2, "approve"), ("a", 3, "processing.succeeded"), ("a", 4, "approve"), ("b", 1, None)], "id string, at int, event string")
    got = {r.id: (r.status, r.illegal_steps) for r in intake.fold(rows, "id", ["at"], "event", "NEW").collect()}
    assert got == {"a": ("APPROVED", 1), "b": ("NEW", 1)}
    runs = intake.islands(spark.createDataFrame([("k", n) for n in (1, 2, 3, 7, 9, 10)], "k string, n int"), "k", "n").collect()
    assert {(r.first, r.last, r.length) for r in runs} == {(1, 3, 3), (7, 7, 1), (9, 10, 2)}


def test_pages_meet_without_gap(spark):
    rows = spark.createDataFrame([(k // 3, k) for k in range(130)], "at int, id int")
    seen, cursor = [], None
    while True:
        page = intake.keyset_page(rows, "at", "id", cursor).collect()
        seen += [r.id for r in page[:50]]
        if len(page) <= 50:
            break
        cursor = (page[49]["at"], page[49]["id"])
    assert seen == list(range(129, -1, -1))
    plan = intake.keyset_page(rows, "at", "id")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_stream_is_idempotent(spark, tmp_path):
    spark.range(20).withColumnRenamed("id", "key").write.parquet(str(tmp_path / "in"))
    done = []
    for attempt in ("a", "b"):
        stream = wrappers.file_stream(spark, str(tmp_path / "in"), "key long")
        wrappers.run_once(stream, lambda new, _: done.append(new.count()), str(tmp_path / f"cp-{attempt}"), str(tmp_path / "ledger"), "key")
    assert done[0] == 20 and sum(done) == 20


def test_stream_into_a_table_is_exactly_once(spark, tmp_path):
    spark.range(30).select((F.col("id") % 10).alias("key"), "id").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for attempt in ("a", "a", "b"):  # drained, nothing new, all of it again by another query whose first batch has the same number
        stream = wrappers.file_stream(spark, str(tmp_path / "in"), "key long, id long")
        wrappers.run_into(stream, lambda new: new.select("key", (F.col("id") * 2).alias("twice")), str(tmp_path / f"cp-{attempt}"), out, "key")
        assert sorted(r.key for r in spark.read.parquet(out).collect()) == list(range(10))


@pytest.mark.parametrize("name", ["status_summary", "latest_per_entity"])
def test_plans_read_only_what_they_need(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, entry.ENTRY_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan.split("ReadSchema")[1] if name == "status_summary" else "WindowGroupLimit" in plan


def test_registry_imports_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and F is not None
