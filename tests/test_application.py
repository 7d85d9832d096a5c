"""Evaluation cases, gate, report, review, export and lifecycle operators beyond what the queries' oracles compare."""

import json

import pytest
from pyspark.sql import functions as F

from quoteproof.functions.folding import folded_text
from quoteproof.operators import evaluation as ev
from quoteproof.operators import export, grounding, lifecycle, requests, review
from quoteproof.schema import HEADER_KEYS, ITEM_KEYS


def case(name="c1", **change):
    fields = {k: None for k in HEADER_KEYS} | {"company": "Muster GmbH", "email": {"value": "a@b.de", "status": "uncertain"}}
    return {"id": name, "categories": ["standard"], "document": "d.eml", "fields": fields, "line_items": [{k: None for k in ITEM_KEYS} | {"quantity": "5"}]} | change


def test_cases(spark, tmp_path):
    for name, raw in (("c1", case()), ("c2", case("c2", categories=["injection"], must_not_found={"company": ["Evil"]}, declared_type="message/rfc822"))):
        (tmp_path / "good" / name).mkdir(parents=True)
        (tmp_path / "good" / name / "expected.json").write_text(json.dumps(raw))
        (tmp_path / "good" / name / "d.eml").write_text("x")
    cases = ev.load_cases(spark, str(tmp_path / "good"))
    rows = ev.expected_rows(cases)
    assert rows.count() == 2 * (len(HEADER_KEYS) + len(ITEM_KEYS)) and [tuple(r) for r in rows.where("case_id = 'c1' and expected_status != 'missing'").select("field", "item_index", "expected_value", "expected_status").orderBy("field").collect()] == [
        ("company", None, "Muster GmbH", "found"), ("email", None, "a@b.de", "uncertain"), ("line_items.quantity", 0, "5", "found")]
    assert [tuple(r) for r in ev.forbidden_rows(cases).collect()] == [("c2", "company", "Evil")]
    bad = {
        "id": case("other"), "none": case("none", categories=[]), "cat": case("cat", categories=["x"]), "doc": case("doc", document="z"), "fields": case("fields", fields={}), "item": case("item", line_items=[{}]),
        "value": case("value", fields={k: 5 for k in HEADER_KEYS}), "must": case("must", must_not_found={"company": []}), "key": case("key", must_not_found={"x": ["y"]}), "inj": case("inj", categories=["injection"]),
    }
    for name, raw in bad.items():
        assert ev.case_of(name, json.dumps(raw), lambda d: d == "d.eml")[0] is None, name
    assert ev.case_of("x", "[", lambda d: True)[0] is None and ev.case_of("c1", json.dumps(case()), lambda d: True)[1] is None
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no cases"):
        ev.load_cases(spark, str(tmp_path / "empty"))


def test_evaluation_chain(spark):
    expected = spark.createDataFrame([("c", "company", None, "Muster  GmbH", "found"), ("c", "email", None, None, "missing"), ("c", "line_items.unit", 0, "pcs", "found"), ("c", "line_items.unit", 1, "kg", "found")], "case_id string, field string, item_index int, expected_value string, expected_status string")
    returned = spark.createDataFrame([("c", "company", None, "MUSTER GmbH", "found", "found", True), ("c", "email", None, "evil@x.de", "uncertain", "found", True), ("c", "line_items.unit", 0, "t", "unverified", "found", True), ("c", "line_items.unit", 2, "m", "found", "found", True)], "case_id string, field string, item_index int, value string, status string, model_status string, has_evidence boolean")
    seen = ev.observe(expected, returned, folded_text)
    got = {(r.field, r.item_index): (r.status, r.correct, r.false_found) for r in seen.collect()}
    assert got == {("company", None): ("found", True, False), ("email", None): ("uncertain", False, False), ("line_items.unit", 0): ("unverified", False, False), ("line_items.unit", 1): ("missing", False, False), ("line_items.unit", 2): ("found", False, True)}
    metrics = ev.every_field(ev.field_metrics(seen))
    rows = {r.field: r for r in metrics.collect()}
    assert set(rows) == set(ev.KEY_FIELDS) and rows["phone"].observations == 0 and rows["phone"].found_accuracy is None
    unit = rows["line_items.unit"]
    assert (unit.found_accuracy, unit.missing_precision, unit.grounding_pass_rate, unit.false_found_rate, unit.false_found, unit.caught_by_verifier) == (0.0, 0.0, 50.0, 100.0, 1, 1)
    bad = ev.injection_violations(seen, spark.createDataFrame([("c", "email", "EVIL@x.de"), ("d", "company", "Muster GmbH")], "case_id string, field string, value string"), folded_text)
    assert [(r.case_id, r.field) for r in bad.collect()] == [("c", "email")]
    text = ev.report_table(metrics).split("\n")
    assert len(text) == 2 + len(ev.KEY_FIELDS) and text[2].split()[:3] == ["company", "1", "100.0"] and len({len(x) for x in text}) == 1
    errors = spark.createDataFrame([("broken", "Unreadable"), ("c", None)], "case_id string, error string")
    results = {r.case_id: (r.correct, r.observations, r.injection_violations, r.error) for r in ev.case_results(seen, errors, bad).collect()}
    assert results == {"c": (1, 5, 1, None), "broken": (0, 0, 0, "Unreadable")}
    changes = ev.case_changes(errors, spark.createDataFrame([("c",), ("old",)], "case_id string"))
    assert {(r.case_id, r.reason) for r in changes.collect()} == {("broken", "added"), ("old", "removed")}
    failures = ev.gate_failures(ev.gate(ev.long_form(metrics).where("field = 'company'"), ev.long_form(metrics).where("field = 'company'")), errors, bad, changes)
    assert {r.kind for r in failures.collect()} == {"error", "injection", "cases"}


def test_gate(spark):
    shape = "field string, metric string, value double"
    before = spark.createDataFrame([("f", "found_accuracy", 90.0), ("f", "false_found_rate", 1.0), ("g", "found_accuracy", None), ("h", "found_accuracy", 50.0), ("i", "found_accuracy", float("nan")), ("j", "found_accuracy", float("inf")), ("k", "found_accuracy", 10.0)], shape)
    now = spark.createDataFrame([("f", "found_accuracy", 84.9), ("f", "false_found_rate", 6.0), ("g", "found_accuracy", 1.0), ("h", "found_accuracy", None), ("i", "found_accuracy", 1.0), ("j", "found_accuracy", 1.0), ("l", "found_accuracy", 1.0)], shape)
    assert {(r.field, r.metric, r.reason) for r in ev.gate(before, now).collect()} == {
        ("f", "found_accuracy", "worse"), ("h", "found_accuracy", "lost"), ("i", "found_accuracy", "not_finite"), ("j", "found_accuracy", "not_finite"), ("k", "found_accuracy", "lost"), ("l", "found_accuracy", "not_in_baseline")}
    assert ev.resolve_threshold(None, {}) == 5.0 and ev.resolve_threshold(None, {"EVAL_GATE_THRESHOLD": "2"}) == 2.0 and ev.resolve_threshold(1.5, {"EVAL_GATE_THRESHOLD": "2"}) == 1.5
    for wrong in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            ev.resolve_threshold(wrong, {})


def test_marks_and_places(spark):
    rows = [("Das Werk Ost", "Werk", ["Das ", "*Werk", " Ost"]), ("Das WERK", "werk", ["Das ", "*WERK"]), ("Das", "Ort", ["*Das"]), ("Das", "", ["*Das"]), ("İ Werk", "werk", ["*İ Werk"]), ("x", "x", ["*x"])]
    frame = spark.createDataFrame([(k, t, q) for k, (t, q, _) in enumerate(rows)], "k int, t string, q string").select("k", review.mark_quote(F.col("t"), F.col("q")).alias("p")).orderBy("k")
    assert [[("*" if p.mark else "") + p.text for p in r.p] for r in frame.collect()] == [x[2] for x in rows]
    mail = {"kind": "email", "part": "body", "line": 3}
    places = [
        (mail, "Zeile 3", "E-Mail"), ({"kind": "email", "part": "header", "header": "Subject"}, "Kopf: Subject", "E-Mail"), ({"kind": "xlsx", "sheet": "T", "cellRange": "A1:B1"}, "T!A1:B1", "Tabellenblatt T"),
        ({"kind": "docx", "part": "table_cell", "table": 1, "row": 2, "cell": 3}, "Tabelle 1, Zeile 2, Zelle 3", "Word-Dokument"), ({"kind": "docx", "part": "paragraph", "paragraph": 4}, "Absatz 4", "Word-Dokument"),
        ({"kind": "pdf", "page": 2, "ocr": True}, "Seite 2", "Seite 2 (Texterkennung)"),
        ({"kind": "msg", "part": "attachment", "attachment": {"index": 1, "name": None}, "inner": {"kind": "msg", "part": "attachment", "attachment": {"index": 0, "name": "b.eml"}, "inner": mail}}, "Zeile 3", "Anhang Anhang 2 – Anhang b.eml – E-Mail"),
    ]
    frame = review.placed(spark.createDataFrame([(k, json.dumps(p)) for k, (p, _, _) in enumerate(places)], "k int, locator string"))
    got = frame.select("k", review.label(F.col("place")).alias("l"), review.heading(F.col("place"), F.col("names")).alias("h"), "context").orderBy("k").collect()
    assert [(r.l, r.h) for r in got] == [x[1:] for x in places] and got[0].context == got[1].context != got[6].context


def test_corrections(spark):
    rows = [("unit", None, "unknown_field"), ("unit", 0, None), ("company", None, None), ("company", 0, "unknown_field"), ("unit", -1, "unknown_field"), ("x", None, "unknown_field")]
    frame = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "k int, f string, i int")
    assert [r.c for r in frame.select("k", review.correction_refusal(F.col("f"), F.col("i")).alias("c")).orderBy("k").collect()] == [r[2] for r in rows]
    reasons = spark.createDataFrame([(0, " ok "), (1, "  "), (2, "x" * 1001), (3, None)], "k int, r string")
    assert [r.v for r in reasons.select("k", review.reason_value(F.col("r")).alias("v")).orderBy("k").collect()] == ["ok", None, None, None]


def test_export_limits(spark):
    items = [(k, "x" * (501 if k == 1 else 3), "1", None, None, None) for k in range(201)]
    frame = spark.createDataFrame([("r", k, *i[1:]) for k, i in enumerate(items)], "request_id string, item_index int, description string, quantity string, unit string, material string, dimensions string")
    fields = {"company": F.lit("c" * 501), "contact_person": F.lit(None).cast("string"), "requested_delivery_date": F.lit("x")}
    got = export.line_items(frame).select(export.limit_violations(F.lit("s" * 301), fields, F.col("items")).alias("v"), F.col("items")[0]["position"].alias("first")).first()
    assert got.v == ["subject", "company", "item 2 description", "lineItems"] and got.first == 1
    none = spark.range(1).select(export.limit_violations(F.lit("y" * 70_000), {"company": F.lit("a")}, F.lit(None).cast(export.ITEMS)).alias("v"), export.payload(F.lit("r"), F.lit("y" * 70_000), F.lit("2026-01-01").cast("timestamp"), fields, F.lit(None).cast(export.ITEMS)).alias("p")).first()
    assert none.v == ["subject", "body"] and none.p is None


def test_cursor_and_budget(spark):
    known = "00000000-0000-0000-0000-00000000000a"
    rows = spark.createDataFrame([(known, 5)], "id string, created_at int")
    assert requests.anchor(rows, known.upper()) == (5, known) and [requests.anchor(rows, x) for x in (None, "x", known[:-1] + "b", 7)] == [None] * 4
    assert requests.among(rows, "id", []).count() == 0 and requests.among(rows, "id", [known]).count() == 1
    order = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "at int, k string")
    assert [r.k for r in requests.newest_first(order, "at", "k").collect()] == ["b", "c", "a"]
    lifecycle.assert_budget(300, 10)
    with pytest.raises(ValueError, match="expiry"):
        lifecycle.assert_budget(330, 10)
    assert lifecycle.without_tenant({"a": rows, "b": rows.withColumn("company_id", F.lit(1))}) == ["a"] and lifecycle.catalogue({"b": rows}) == [("b", 2, False)]


def test_levels_of_a_locator_are_read_once_each(spark):
    """What reads a locator grows with its columns, not with the levels times what each names."""
    inner = '{"kind":"pdf","page":2}'
    wrap = lambda x, at: '{"kind":"msg","part":"attachment","attachment":' + at + ',"inner":' + x + "}"
    told = [None, "no json", inner, wrap(inner, '{"index":1,"name":"a.msg"}'), wrap(wrap(inner, '{"index":3,"name":""}'), "{}"), '{"kind":"msg","part":"body","inner":"x"}', wrap(inner, "{}").replace("msg", "\\u006dsg")]
    frame = spark.createDataFrame(list(enumerate(told)), "k int, l string").select("k", review.unwrapped(F.col("l")).alias("u"))
    got = [(r.u.inner, r.u.names, r.u.path) for r in frame.orderBy("k").collect()]
    assert got == [(None, [], ""), ("no json", [], ""), (inner, [], ""), (inner, ["a.msg"], "1"), (inner, ["Anhang 1", "Anhang 4"], "?/3"), (told[5], [], ""), (inner, ["Anhang 1"], "?")]
    assert frame._jdf.queryExecution().analyzed().toString().count("get_json_object(") <= 5


def test_answers_are_refused_by_tasks_of_bounded_size(spark, monkeypatch):
    """Segments of many small rows are not merged into one task again; nulls as before."""
    monkeypatch.setattr("quoteproof.functions.dealing.MOST_ROWS", 10)
    fields = [("a", "found", "s1", "q"), ("a", "found", "s9", "q"), ("b", "found", None, "q"), ("c", "missing", None, None), (None, "found", "s1", "q"), ("d", "found", "s1", None)]
    held = [("a", "s1"), ("d", "s1"), ("d", "s1"), ("e", None), ("e", None), *(("f", f"s{k}") for k in range(100))]
    answers = spark.createDataFrame([("a", "a"), ("g", "h"), ("i", None)], "document_id string, answered_id string")
    frame = spark.createDataFrame(fields, "document_id string, status string, segment_id string, quote string"), spark.createDataFrame(held, "document_id string, segment_id string")
    got = lifecycle.rejected_answers(answers, *frame)
    want = {("a", "unknown_segment"), ("b", "found_without_evidence"), ("d", "segment_twice"), ("d", "found_without_evidence"), ("e", "segment_twice"), ("g", "document_id"), ("i", "document_id")}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "hashpartitioning(document_id#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    assert {r.document_id for r in grounding.rejected_documents(*frame).collect()} == {"a", "b", "d", "e", None}
