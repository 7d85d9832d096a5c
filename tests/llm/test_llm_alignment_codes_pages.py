"""Operators 11 to 13 against brute force, and on messy tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from quoteproof.llm import op11_alignment as op11, op12_vector_codes as op12, op13_pages as op13
from quoteproof.llm._encode import tokenizer_path


def table(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# 11 ----------------------------------------------------------------------------------------------------------------


def library_alignment(docs):
    """Every figure by plain loops over the libraries' own tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    bytes_, pieces = Tokenizer.from_file(tokenizer_path(op11.BYTE_LEVEL)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(op11.PIECES))
    bytes_.encode_special_tokens = True
    of_a = op11.byte_level_bytes(tokenizer_path(op11.BYTE_LEVEL))

    def of_b(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    found, counts, top = [], collections.Counter(), collections.Counter()
    for doc, text in docs:
        a, b = (bytes_.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(of_a[i] for i in a) != want or b"".join(map(of_b, b)) != want:
            found.append((doc, None))
            continue
        ends = [[], []]
        for side, (ids, of) in enumerate(((a, of_a.__getitem__), (b, of_b))):
            n = 0
            for i in ids:
                n += len(of(i))
                ends[side].append(n)
        links = [(i, j) for e, i in zip(ends[0], a) for f, j in zip(ends[1], b) if e == f] if len(a) < 300 else [(dict(zip(ends[0], a))[f], j) for f, j in zip(ends[1], b) if f in set(ends[0])]
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for e, i in zip(ends[s], ids) if last < e <= cut) for s, ids in ((0, a), (1, b))))
            last = cut
        counts.update(links)
        found.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4])
        for d, x in found
    ]


def test_op11(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op11, "RUN_CHARS", 400)
    rng = random.Random(11)
    parts = [*"abcXYZ019.,!'’ \n\t é日😀▁²½ß<>|", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\0", "\x7f", "​", "don't", "  ", "\r\n", "ﬁ", "　", "\x85"]
    docs = [(k % 2000, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for k in range(2500)] + [(None, "no id"), (7, None), (-1, ""), (8, " "), (9, "same text"), (9, "same text")]
    docs += [(5000, " ".join(rng.choices(["the", "word.", "x\ny", "日本", "A,B"], k=250))), (5001, "x" * 1500), (5002, " ".join(["clean words"] * 60) + " bad▁one")]
    frame = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in docs], "doc_id long, text string, n_a int, pairs string, _text string").repartition(3)
    got = [tuple(r) for r in op11.op11_common_cut_alignment(spark, table(frame, tmp_path / "d", "documents")).collect()]
    assert order(got) == order(library_alignment(docs))
    assert sum(r[1] > 0 for r in got) > 1000 and sum(r[1] == 0 for r in got) > 300
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op11.op11_common_cut_alignment(spark, table(empty, tmp_path / "e", "documents")).count() == 0


def test_op11_bound_and_long_texts():
    tool = op11.aligner(tokenizer_path(op11.BYTE_LEVEL), tokenizer_path(op11.PIECES))
    assert tool.most_pairs() < 500_000  # what is broadcast at most
    rng = random.Random(3)
    text = " ".join(rng.choices(["alpha", "Beta,", "gamma", "d'or", "x-1"], k=3000))
    whole, runs = tool.align([text])[0], tool.document(op11.runs_of(text, 500))
    assert len(op11.runs_of(text, 500)) > 20 and " ".join(op11.runs_of(text, 500)) == text
    assert whole[:4] == runs[:4] and hashlib.sha256(whole[4]).hexdigest() == runs[4]
    assert (whole[5] == runs[5]).all() and (whole[6] == runs[6]).all()


# 12 ----------------------------------------------------------------------------------------------------------------


def plain_lloyd(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.asarray([[math.floor(1024 * v) for v in r[1]] for r in kept], dtype=np.int64)
    seeds = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[k].tolist()))[:entries]
    w = x.shape[1] // 4
    books = [x[seeds, p * w : (p + 1) * w].copy() for p in range(4)]

    def nearest(p):
        d = np.stack([((x[:, p * w : (p + 1) * w] - c) ** 2).sum(1) for c in books[p]], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(4):
            own = nearest(p)[0]
            for e in range(len(books[p])):
                if (own == e).any():
                    books[p][e] = x[own == e, p * w : (p + 1) * w].sum(0) // (own == e).sum()
    last = [nearest(p) for p in range(4)]
    error = sum(d for _, d in last)
    by_label = collections.Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{own[k]:02x}" for own, _ in last), int(error[k]), by_label[r[2]], digest) for k, r in enumerate(kept)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, sums int, bounds string"


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "large"])
def test_op12(spark, tmp_path, kind):
    rng = random.Random(kind)
    n, scale = {"spread": (1500, 0.3), "ties": (1500, 0.004), "few": (40, 0.3), "large": (600, 9000.0)}[kind]
    rows = [(rng.randint(0, 4000), [rng.gauss(0, scale) if kind != "ties" else rng.randint(-3, 3) / 1024 for _ in range(12)], rng.choice([1, 2, None])) for _ in range(n)]
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    rows += [(1, None, 1), (2, [0.1] * 11 + [None], 1), (3, [0.1] * 11 + [math.nan], 2), (4, [math.inf] + [0.0] * 11, 2), (None, [0.25] * 12, None), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in op12.op12_yinyang_codes(spark, table(frame, tmp_path / "v", "embeddings")).collect()]
    assert order(got) == order(plain_lloyd(rows))


def test_op12_bounds_spare_work_and_odd_tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    entries = rng.integers(-500, 500, (64, 8))
    x = entries[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 8))
    group = op12.entry_groups(entries)
    n = group.max() + 1
    own, best, bounds, scanned = op12.assign(x, entries, group, np.zeros(2000, dtype=np.int64), np.zeros((2000, n)))
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (own == far.argmin(1)).all() and (best == far.min(1)).all() and scanned == 2000 * n
    moved = entries + rng.integers(-3, 4, entries.shape)
    drift = np.asarray([np.sqrt(((moved - entries) ** 2).sum(1))[group == g].max() for g in range(n)])
    own2, _, _, fewer = op12.assign(x, moved, group, own, np.floor(bounds) - drift)
    assert (own2 == ((x[:, None] - moved[None]) ** 2).sum(2).argmin(1)).all() and fewer < scanned / 4
    mixed = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.25] * 8, 1), (3, [0.5] * 4, 1), (4, [], None)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in op12.op12_yinyang_codes(spark, table(mixed, tmp_path / "m", "embeddings")).collect()}
    assert got[1].code == "00000000" and got[2].code == "01010101" and got[1].label_error == 0
    assert got[3].code is None and got[3].error is None and got[4].label_error is None
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op12.op12_yinyang_codes(spark, table(empty, tmp_path / "e", "embeddings")).count() == 0


def test_op12_many_labels(spark, monkeypatch):
    monkeypatch.setattr(op12, "FEW_LABELS", 10)
    rows = [(k, k % 40 if k % 3 else None, "00", k) for k in range(600)]
    want = collections.Counter()
    for _, label, _, e in rows:
        want[label] += e
    coded = spark.createDataFrame(rows, "vec_id long, label int, code string, error long")
    got = op12.with_label_error(coded).collect()
    assert len(got) == 600 and all(r.label_error == want[r.label] for r in got)


# 13 ----------------------------------------------------------------------------------------------------------------


def longest(a, b):
    table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
    return table_[-1][-1]


@pytest.mark.parametrize("cells", [1 << 26, 12])
def test_op13_alignment(monkeypatch, cells):
    monkeypatch.setattr(op13, "MOST_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(1500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = op13.common(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        assert len(found) == longest(a, b)


def test_op13_lines():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li>Home<li>News</ul></nav><div class="cookieNotice">We use cookies</div><div id=ad-1>Buy</div><aside>Side</aside>
    <main><article class="post"><header><h1>Title &amp; more</h1></header><p>First <b>bold<br>line<p>Second &lt;b&gt;&nbsp;x &am</p><script>if (a < b) "<p>no</p>"</script>
    <div hidden>secret</div><form><p>Name <input></form><table><tr><td>one<td>two</table><!-- <p>gone</p> --><article class="comment">I agree</article><p data-x="a>b">Last</article></main>
    <section class="comments"><p>Reader says</section><footer><p>&copy; x</footer>"""
    marked = op13.page_lines(page)
    assert [t for t, m in marked if m == op13.ARTICLE] == ["Title & more", "First bold line", "Second <b> x &am", "one", "two", "Last"]
    assert {t for t, m in marked if m == op13.DROP} == {"Site", "Home", "News", "We use cookies", "Buy", "Side", "secret", "Name", "I agree", "Reader says", "© x"}
    assert op13.page_lines("") == [] and op13.page_lines("<p") == [] and op13.page_lines("a < b") == [("a < b", op13.OPEN)]
    assert op13.page_lines("<div>" * 3000 + "deep" + "</div>" * 3000) == [("deep", op13.OPEN)]


def site(rng, host, n, marked=False):
    """Pages whose furniture has no telling names, and their main text."""
    for k in range(n):
        body = [f"Paragraph {host} {k} {j} " + " ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=rng.randint(8, 30))) for j in range(rng.randint(2, 5))]
        if k % 100 in (0, 3):  # a short line that one neighbour shares
            body.insert(1, "Yes.")
        top = [f"Welcome to {host} the home of everything", "Home", "News", "Sport"]
        end = [f"All rights reserved by {host} and its many partners", "Imprint"]
        lines = ["<div class=x1>" + "".join(f"<p>{t}" for t in part) + "</div>" for part in (top, body, end)]
        if marked:
            lines[1] = f"<article>{lines[1]}</article>"
        yield f"http://{host}/a/{k:03d}", "<html><body>" + "".join(lines), "\n\n".join(body)


def plain_differences(rows, near):
    """The result by whole lists: neighbours in the order of the keys, each pair's shared runs, votes."""
    pages = []
    for page_id, url, text in rows:
        m = __import__("re").match(op13._URL.replace("(.*)$", "(.*)"), url or "")
        host, path = (m[1].lower(), m[2][: op13.PATH_CHARS]) if m else ("", "")
        pages.append(((host, path, page_id), host, op13.page_lines(text or ""), page_id, url))
    pages.sort(key=lambda p: p[0])
    votes, sure = [collections.Counter() for _ in pages], [set() for _ in pages]
    for i in range(len(pages)):
        for j in range(i + 1, min(len(pages), i + near + 1)):
            (_, host, a, *_), (_, other, b, *_) = pages[i], pages[j]
            pairs = op13.common([t for t, _ in a], [t for t, _ in b]) if host and host == other else []

            def copy(lines, shared):
                own = [k for k, (_, m) in enumerate(lines) if m != op13.DROP]
                long = {k: len(lines[k][0].split()) for k in own if len(lines[k][0].split()) >= op13.LONG_WORDS}
                return set(own) <= shared or 2 * sum(n for k, n in long.items() if k in shared) > sum(long.values())

            if not pairs or copy(a, {x for x, _ in pairs}) or copy(b, {y for _, y in pairs}):
                continue
            run = []
            for k, (x, y) in enumerate(pairs):
                run.append((x, y))
                votes[i][x] += 1
                votes[j][y] += 1
                if k + 1 == len(pairs) or pairs[k + 1] != (x + 1, y + 1):
                    if sum(len(a[p][0].split()) for p, _ in run) >= op13.RUN_WORDS:
                        sure[i] |= {p for p, _ in run}
                        sure[j] |= {q for _, q in run}
                    run = []
    out = []
    for k, (_, _, lines, page_id, url) in enumerate(pages):
        best = max((m for _, m in lines), default=0)
        kept = [t for n, (t, m) in enumerate(lines) if m == best and m and not (m != op13.ARTICLE and (n in sure[k] or votes[k][n] > 1))]
        out.append((page_id, url, "\n\n".join(kept), len("\n\n".join(kept))))
    return out


def test_op13(spark, tmp_path, monkeypatch):
    rng = random.Random(13)
    made = [p for host, n in (("big.example.org", 150), ("small.example.org", 12), ("one.example.org", 1)) for p in site(rng, host, n)]
    made += list(site(rng, "marked.example.org", 20, marked=True))
    rows = [(k, url, text) for k, (url, text, _) in enumerate(made)]
    want = {k: (url.split("/")[2], text) for k, (url, _, text) in enumerate(made)}
    copy = made[5]
    rows += [(900 + k, f"http://big.example.org/a/{k:03d}x", copy[1]) for k in range(60)]  # copies of one article all over the host
    rows += [(None, None, None), (990, None, "<p>no url"), (991, "not a url", "<p>odd url"), (992, "http://big.example.org/a/005", ""), (993, "//BIG.example.org:80/a/006?x", "<nav>menu</nav>")]
    rows += [(994, "http://dup.example.org/", "<p>twice"), (994, "http://dup.example.org/", "<p>twice")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, range int").repartition(4)
    results = []
    for size in (8 << 20, 3000):  # one range, and many
        monkeypatch.setattr(op13, "RANGE_BYTES", size)
        results.append(order(tuple(r)[:4] for r in op13.op13_url_differencing(spark, table(frame, tmp_path / str(size), "pages")).collect()))
    plain = order(plain_differences([(i if i is not None else -(2**63), u, t) for i, u, t in rows], op13.NEAR))
    assert results[0] == results[1] == order((None if r[0] == -(2**63) else r[0], *r[1:]) for r in plain)
    texts = {r[0]: r[2] for r in results[0]}
    for k, (host, text) in want.items():
        if host != "one.example.org":  # a host of one page has no neighbour to tell its furniture
            assert texts[k] == text
    assert all(texts[900 + k] == copy[2] for k in range(60))
    assert texts[None] == "" and texts[990] == "no url" and texts[992] == "" and texts[993] == ""
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert op13.op13_url_differencing(spark, table(empty, tmp_path / "e", "pages")).count() == 0


def test_workers_drop_what_other_stages_kept(spark):
    """Workers are used again; a task finds only what it says it uses."""
    import pyarrow as pa
    from quoteproof.llm import _encode, _shared

    assert _shared.KEPT["encoders"] is _encode._ENCODERS

    def fill(batches):
        from quoteproof.llm import _encode as own

        own._ENCODERS["test"] = 1
        yield from batches

    def see(batches):
        from quoteproof.llm import _encode as own

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["test" in own._ENCODERS] * batch.num_rows)], names=["held"])

    rows = spark.range(0, 64, 1, 16)
    rows.mapInArrow(_shared.frugal(fill, "encoders"), "id long").count()
    held = lambda *uses: sum(r.held for r in rows.mapInArrow(_shared.frugal(see, *uses), "held boolean").collect())
    assert held("encoders") > 0 and held() == 0
