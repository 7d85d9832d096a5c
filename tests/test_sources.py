"""Readers with their places, attachments, uploads, mail headers, sinks."""

import http.server
import io
import json
import threading
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quoteproof.sources import attachments as at
from quoteproof.sources import readers, sinks, uploads

MAIL = b"From: A <a@b.de>\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nContent-Type: text/plain; charset=utf-8\n\nErste\n\n dritte  Zeile\n"


def package(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(rows: str, second: str = "", mode: str = "") -> bytes:
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rel = f'<Relationship Id="{{}}" Type="{r}/{{}}" Target="{{}}"/>'
    rels = rel.format("r1", "worksheet", "worksheets/sheet2.xml") + rel.format("r2", "worksheet", "/xl/worksheets/sheet1.xml") + rel.format("r3", "chartsheet", "chartsheets/sheet1.xml")
    return package(**{
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><workbookPr {mode}/><sheets><sheet name="Diagramm" r:id="r3"/><sheet name="Teile" r:id="r1"/><sheet name="Rest" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="170" formatCode="[$-407]dd.mm.yyyy"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/><numFmt numFmtId="172" formatCode="[h]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>Flansch</t></si><si><r><t>Rohr </t></r><r><t>DN 50</t></r><rPh><t>x</t></rPh></si></sst>',
        "xl/worksheets/sheet2.xml": SHEET.format(rows), "xl/worksheets/sheet1.xml": SHEET.format(second),
    })


def test_xlsx():
    rows = (
        '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>4.0</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><v>0.1</v></c></row><row r="3"><c r="A3"/></row>'
        '<row r="5"><c r="A5" s="1"><v>45000</v></c><c r="B5" s="2"><v>45000.5</v></c><c r="C5" s="1"><v>0.25</v></c><c r="D5" s="3"><v>7</v></c><c r="E5" s="4"><v>1.5</v></c></row>'
        '<row><c t="inlineStr"><is><t>ohne Nummer</t></is></c></row><row r="9"><c r="AA9" t="str"><v> =x </v></c><c r="AB9" t="e"><v>#DIV/0!</v></c></row>'
    )
    got = readers.parse_xlsx(workbook(rows, '<row r="1"><c r="A1" t="s"><v>1</v></c></row>'))
    assert [(s.id, s.text, s.locator["cellRange"], s.locator["sheet"]) for s in got] == [
        ("s1-r2", "Flansch | 4 | TRUE | 0.1", "B2:E2", "Teile"), ("s1-r5", "2023-03-15 | 2023-03-15 12:00 | 06:00:00 | 7 | 1 day, 12:00:00", "A5:E5", "Teile"),
        ("s1-r6", "ohne Nummer", "A6", "Teile"), ("s1-r9", "=x | #DIV/0!", "AA9:AB9", "Teile"), ("s2-r1", "Rohr DN 50", "A1", "Rest"),
    ]
    assert readers.parse_xlsx(workbook('<row r="1"><c r="A1" s="1"><v>0</v></c></row>', mode='date1904="1"'))[0].text == "1904-01-01"
    assert [readers.column_letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    table = (
        f'<w:tbl><w:tr>{cell("breit", "<w:gridSpan w:val=&quot;2&quot;/>".replace("&quot;", chr(34)))}{cell("hoch", "<w:vMerge w:val=&quot;restart&quot;/>".replace("&quot;", chr(34)))}</w:tr>'
        f'<w:tr>{cell("a")}<w:tc><w:tbl><w:tr>{cell("innen")}</w:tr></w:tbl>{p("b")}{p("c")}</w:tc>{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    )
    body = f'{p("Eins")}{p(" ")}<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>z</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>weg</w:delText></w:r></w:del></w:p>{table}'
    got = readers.parse_docx(package(**{"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'}))
    assert [(s.id, s.text) for s in got] == [("d-p1", "Eins"), ("d-p3", "x y z"), ("d-t1-r1-c1", "breit"), ("d-t1-r1-c3", "hoch"), ("d-t1-r2-c1", "a"), ("d-t1-r2-c2", "b c")]
    assert got[1].locator == {"kind": "docx", "part": "paragraph", "paragraph": 3} and got[3].locator["cell"] == 3


def test_mail_and_html():
    got = readers.parse_eml(MAIL)
    assert [(s.id, s.text, s.line) for s in got] == [("eml-h-from", "From: A <a@b.de>", 1), ("eml-h-subject", "Subject: Grüße", 2), ("eml-l1", "Erste", 1), ("eml-l3", "dritte  Zeile", 3)]
    strange = b"From:\nSubject: x\nContent-Type: text/plain; charset=none-such\n\nk\xc3\xb6nnte\n"
    assert [(s.id, s.text, s.line) for s in readers.parse_eml(strange)] == [("eml-h-subject", "Subject: x", 1), ("eml-l1", "könnte", 1)]
    page = b"Subject: h\nContent-Type: text/html\n\n<p>eins<br>zwei</p><script>nein</script>"
    assert [s.text for s in readers.parse_eml(page)] == ["Subject: h", "eins", "zwei"]
    told = {"<head><title>t</title></head><p>a <b>b</b></p><script>x</script><br>c": "a b\nc", "a&nbsp;b\r\n c &lt;d&gt;": "a b\nc <d>", "</script>x<style>y": "x", "<td>1</td><td>2": "1\n2", "": "", "<!-- c --><div/>e": "e"}
    assert {h: readers.html_to_text(h) for h in told} == told


def test_kinds_and_limits(monkeypatch):
    ole = bytes.fromhex("d0cf11e0a1b11ae1")
    told = {b" \n%PDF-1.4": "pdf", MAIL: "eml", workbook(""): "xlsx", package(x="y"): "unsupported", ole + "__properties_version1.0".encode("utf-16-le"): "msg", ole: "unsupported", b"plain": "unsupported", b"": "unsupported"}
    assert {d: readers.detect_kind(d) for d in told} == told and readers.detect_kind(b"x", "Message/RFC822; charset=x") == "eml"
    bomb = package(**{"word/document.xml": "a" * (2 << 20)})
    with pytest.raises(readers.Unreadable, match="document_unparseable"):
        readers.open_package(bomb)
    monkeypatch.setattr(readers, "MOST_PART", 10)
    with pytest.raises(readers.Unreadable, match="document_too_long"):
        readers.open_package(workbook(""))


def test_segments_of_files(spark):
    files = spark.createDataFrame([("a.eml", bytearray(MAIL)), ("b.xlsx", bytearray(workbook('<row r="1"><c r="A1"><v>1</v></c></row>'))), ("c.pdf", bytearray(b"%PDF-1.4")), ("d", bytearray(b"PK\x03\x04bad")), ("e", None)], "path string, content binary")
    got = readers.segments(files).collect()
    assert {r.path: r.error for r in got if r.error} == {"c.pdf": "unsupported_media_type", "d": "unsupported_media_type", "e": "unsupported_media_type"}
    assert [(r.text, json.loads(r.locator)["cellRange"]) for r in got if r.kind == "xlsx"] == [("1", "A1")] and sum(r.kind == "eml" for r in got) == 4


def test_attachments():
    own = [readers.Segment("msg-l1", "x", {"kind": "msg", "part": "body", "line": 1})]
    inner = at.Message(own, [at.Attachment(0, "in.eml", MAIL)])
    outer = at.Message(own, [at.Attachment(0, "a.eml", MAIL), at.Attachment(1, None, message=inner), at.Attachment(2, "p", b"%PDF-"), at.Attachment(3, "r", by_value=False), at.Attachment(4, "e"), at.Attachment(50, "z", MAIL)])
    segments, reports = at.expand(outer)
    assert [s.id for s in segments][:5] == ["msg-l1", "msg-a0-eml-h-from", "msg-a0-eml-h-subject", "msg-a0-eml-l1", "msg-a0-eml-l3"] and segments[-1].id == "msg-a1-msg-a0-eml-l3"
    assert segments[-1].locator["inner"]["inner"]["line"] == 3
    assert [(r.path, r.status, r.error, r.segments) for r in reports] == [
        ((0,), "parsed", None, 4), ((1,), "parsed", None, 5), ((1, 0), "parsed", None, 4), ((2,), "failed", "unsupported_media_type", 0), ((3,), "failed", "not_attached_by_value", 0),
        ((4,), "failed", "document_unparseable", 0), ((50,), "failed", "too_many_attachments", 0),
    ]
    deep = at.Message([], [])
    for _ in range(5):
        deep = at.Message([], [at.Attachment(0, "d", message=deep)])
    assert at.expand(deep)[1][-1].error == "nesting_too_deep"
    assert [r.error for r in at.expand(outer, at.Budget(attachments=1))[1]][:2] == [None, "budget_exceeded"]
    assert at.expand(at.Message([], [at.Attachment(0, "x", workbook(""))]), at.Budget(unzipped=[10]))[1][0].error == "budget_exceeded"


def test_attachment_tables_follow_the_same_limits(spark):
    """Random trees of attachments: the table's reports are those of the reader of one document."""
    import random

    rng = random.Random(12)

    def message(depth: int, path: tuple, rows: list) -> at.Message:
        own = []
        for k in range(rng.randint(0, 4)):
            i, kind = (rng.choice([k, 60]) if rng.random() < 0.1 else k), rng.choice(["mail", "book", "bad", "none", "ref", "msg", "msg"])
            here, rows_at = (*path, i), len(rows)
            rows.append(None)
            inner = message(depth + 1, here, rows) if kind == "msg" and depth < 5 else None
            data = {"mail": MAIL, "book": BOOK, "bad": b"%PDF-"}.get(kind)
            rows[rows_at] = (list(here), kind, kind != "ref", BOOK_BYTES if kind == "book" else 0, {"bad": "unsupported_media_type"}.get(kind, None if data or inner else "document_unparseable"))
            own.append(at.Attachment(i, kind, data, message=inner, by_value=kind != "ref"))
        return at.Message([], own)

    book = workbook("")
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        size = sum(x.file_size for x in z.infolist())
    BOOK, BOOK_BYTES = book, size
    want, rows = {}, []
    for d in range(40):
        mine: list = []
        tree = message(1, (), mine)
        if len({tuple(r[0]) for r in mine}) < len(mine):
            continue
        _, told = at.expand(tree, at.Budget(6, [2 * size + 1]))
        want |= {(d, r.path): (r.status, r.error) for r in told}
        rows += [(d, *r) for r in mine]
    frame = spark.createDataFrame(rows, "document_id int, path array<int>, name string, by_value boolean, unzipped long, error string")
    got = {(r.document_id, tuple(r.path)): (r.status, r.error) for r in at.reports(frame, 6, 2 * size + 1).collect()}
    assert got == want and len({e for _, e in got.values()}) >= 6


def test_uploads(spark):
    good = package(**{"[Content_Types].xml": "", "xl/workbook.xml": ""})
    cases = [
        ("C:\\x\\a.XLSX", good, None), ("b.exe", b"x", "type"), ("c.eml", b"", "empty"), ("d.pdf", b"%PDF-" + b"0" * 2000, "too_large"), ("e.pdf", b"PK", "content"), ("f.docx", good, "content"), ("noext", b"x", "type"),
        ("g.xlsx", package(**{"[Content_Types].xml": "", "xl/workbook.xml": "", "xl/vbaProject.bin": ""}), "macros"), ("h.eml", MAIL, None), ("i.eml", b"Foo: bar\n\nx", "content"), ("../\x01\n", b"x", "type"),
    ]
    frame = spark.createDataFrame([(k, n, bytearray(c)) for k, (n, c, _) in enumerate(cases)], "k int, name string, content binary")
    got = uploads.classified(frame, 1500).orderBy("k").collect()
    assert [r.reject_reason for r in got] == [x[2] for x in cases]
    assert got[0].filename == "a.XLSX" and got[0].kind == "xlsx" and got[0].content_type.endswith("sheet") and got[-1].filename == "datei" and got[1].kind is None


def test_mail_headers(spark):
    told = {
        b"Message-ID: <1@x>\r\nSubject: =?utf-8?B?R3LDvMOf?=\r\n =?UTF-8?Q?e_=C3=A4?=\r\n\r\nSubject: body": ("<1@x>", "Grüße ä"), b"subject:  direkt \xc3\xa4\n\nx": (None, "direkt ä"), b"X: y": (None, None),
        b"Subject: =?none?Q?a=62?=\n": (None, "ab"), b"Subject: " + b"s" * 400: (None, "s" * 300),
    }
    assert {d: uploads.mail_headers(d) for d in told} == told
    got = spark.createDataFrame([(bytearray(d),) for d in told], "c binary").select(uploads.headers_of("c").alias("h")).select("h.*").collect()
    assert [tuple(r) for r in got] == list(told.values())


def test_rest_sink(spark):
    seen, answers = [], iter([(201, '{"erpReference":"QR-1","requestId":"a"}'), (503, ""), (200, "{}")])

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["content-length"])).decode()
            seen.append((self.path, self.headers["idempotency-key"], self.headers["authorization"], body))
            status, text = next(answers)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        calls = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("c", "{}")], "request_id string, body string").coalesce(1)
        got = sinks.submit(calls, f"http://127.0.0.1:{server.server_port}/", "secret").orderBy("request_id").collect()
    finally:
        server.shutdown()
    assert [(r.http_status, r.transport_error) for r in got] == [(201, None), (503, None), (200, None)]
    assert seen[0] == ("/v1/quote-requests", "a", "Bearer secret", "{}")
    assert sinks.post(f"http://127.0.0.1:{server.server_port}/", "t", "k", "{}", 0.5)[1] in ("timeout", "unreachable")
    with pytest.raises(ValueError, match="token"):
        sinks.submit(calls, "http://x", "")


def test_blobs_and_log(spark, tmp_path):
    store = sinks.BlobStore(spark, str(tmp_path / "blobs"))
    store.put("a/b.bin", bytes(range(256)))
    assert store.get("a/b.bin") == bytes(range(256)) and [r.length for r in store.table("*.bin").collect()] == [256]
    assert store.delete("a/b.bin") and not store.delete("a/b.bin")
    with pytest.raises(ValueError, match="below"):
        store.put("../x", b"")
    row = spark.createDataFrame([("r", "s")], "requestId string, secret string")
    assert sinks.json_names(row.select(sinks.log_line("info", "e", row).alias("l")).first().l) == {"level", "requestId", "msg"} and F is not None


def test_reader_hands_rows_on_in_bounded_batches(spark, monkeypatch):
    """However many files a batch has, a task holds only so many rows, and all of them come out once and in order."""
    from quoteproof.sources import readers

    seen = []
    class Files:  # noqa: E301  takes the function that Spark would run
        columns, select = ("path", "content"), lambda self, *_: self
        mapInArrow = lambda self, run, _: seen.append(run)
    mail = lambda k: b"From: a\n\n" + b"\n".join(b"line %d %d" % (k, n) for n in range(2000))
    files = pa.RecordBatch.from_arrays([pa.array(["1", "2", "3"]), pa.array([mail(1), b"\0", mail(3)], pa.binary()), pa.array([None] * 3, pa.string())], names=["path", "content", "declared"])
    monkeypatch.setattr(readers, "MOST_HELD", 100_000)
    readers.segments(Files())
    out = list(seen[0]([files]))
    rows = [(r["path"], r["position"], r["error"]) for b in out for r in b.to_pylist()]
    assert max(b.num_rows for b in out) <= 201 and rows == [*(("1", k, None) for k in range(2001)), ("2", 0, "unsupported_media_type"), *(("3", k, None) for k in range(2001))]
