"""Whole extraction runs by hand."""

from quoteproof.operators import extraction
from quoteproof.schema import CLAIMS, HEADER_KEYS, SEGMENTS


def test_runs_and_fields(spark):
    documents = spark.createDataFrame([("full",), ("empty",), ("items",)], "document_id string")
    segments = spark.createDataFrame([("full", "s1", 0, "Muster GmbH, 5 Stk.", None, None, 1, False), ("items", "s1", 0, "7 Stk.", None, None, 1, False)], SEGMENTS)
    claims = spark.createDataFrame([
        ("full", "company", None, "Muster GmbH", "found", "s1", "Muster GmbH"), ("full", "email", None, "a@b.de", "found", "s1", "Muster"), ("items", "quantity", 0, "7", "found", "s1", "7 Stk."),
        ("empty", "company", None, "Erfunden", "found", "s1", "Erfunden"), ("empty", "quantity", 0, "1", "found", "s1", "1"),
    ], CLAIMS)
    got = extraction.fields(documents, segments, claims).collect()
    shown = {(r.document_id, r.field_key, r.item_index): (r.status, r.value) for r in got}
    assert len(got) == 3 * len(HEADER_KEYS) + 1
    assert shown["full", "company", None] == ("found", "Muster GmbH") and shown["full", "email", None] == ("unverified", "a@b.de")
    assert shown["items", "quantity", 0] == ("found", "7") and shown["items", "company", None] == ("missing", None)
    assert {v for (d, _, _), v in shown.items() if d == "empty"} == {("missing", None)}  # no model was asked, so nothing can be found
    reports = spark.createDataFrame([("full", "parsed"), ("full", "failed"), ("full", "failed"), ("items", "parsed")], "document_id string, status string")
    skipped = spark.createDataFrame([("empty", 2), ("items", 0)], "document_id string, pages int")
    runs = {r.document_id: (r.n_segments, r.model_called, r.warnings) for r in extraction.runs(documents, segments, reports, skipped).collect()}
    assert runs == {"full": (1, True, ["attachment_failed"]), "empty": (0, False, ["no_text", "ocr_pages_skipped"]), "items": (1, True, [])}
    assert sorted(r.document_id for r in extraction.asked(documents, segments).collect()) == ["full", "items"]
