"""HTML extraction by nearest-URL page differencing.

A page becomes lines, one a block of text, each with what the markup says of it: surely no main text (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, hidden parts), nothing, content by its name, main, or
article. Pages of a host are ordered by URL path and paired with the ``NEAR`` next ones on either side; a pair's lines are
aligned by their longest common subsequence, and shared lines are deleted: those in a shared run of at least ``RUN_WORDS`` words,
and shorter ones that two neighbours share. A pair that shares most of its long lines (copies of one article) or all of a
page tells nothing. Main text is what is left of the best marked lines of the page.

Lines inside a marked article are not deleted, since articles share paragraphs with each other that are their own text.

The order over all pages is cut into ranges of bounded size by keys at fixed ranks; a range's first and last pages are also
sent to the range beside it, so that each page meets the same neighbours however the ranges fall. Ranges are sorted and read
as streams that hold 2 ``NEAR`` + 1 pages.

Null html is empty; pages without lines have an empty text; a null or odd URL has no host and no neighbours; repeated rows
are rows of their own and each other's copies; rows equal in id, URL and html stay in one range; other columns
are not carried; an empty table gives an empty result. White space is Unicode's; ``br`` is white space inside a block.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._encode import text_blocks
from ._shared import discard, frugal, load, materialise

#: Neighbours on either side.
NEAR = 4
#: Words that make a shared run tell by itself, and a line long.
RUN_WORDS, LONG_WORDS = 5, 12
#: Bytes of html in a range, and the most ranges.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16
#: Characters of a path that count for the order.
PATH_CHARS = 256
#: Cells of an alignment that is kept whole as bits; larger ones are halved first.
MOST_CELLS = 1 << 26

DROP, OPEN, CONTENT, MAIN, ARTICLE = range(5)

#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math object select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What marks text that is no main text.
ASIDE_TAGS = frozenset("nav aside footer form button menu dialog head search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus "
    "reply replies respond reactions widget widgets toolbar pagination pager skip search form".split()
)
CONTENT_WORDS = frozenset("article story post entry content main".split())
NOT_WORDS = frozenset("has with no without is not".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(.*)$"


def _marked(tag: str, attributes: str, inside: int) -> int | None:
    """What an element says of the text in it; None: nothing new. ``inside`` is what its surroundings say."""
    mark = {"article": ARTICLE, "main": MAIN}.get(tag)
    if tag in ASIDE_TAGS or (tag == "header" and inside < MAIN):
        return DROP
    if not attributes or attributes.isspace():
        return mark
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return DROP
    roles = set(found.get("role", "").lower().split())
    if roles & ASIDE_ROLES:
        return DROP
    if "main" in roles:
        mark = max(mark or MAIN, MAIN)
    if "articleBody" in found.get("itemprop", "").split() or "article" in roles:
        mark = ARTICLE
    if tag in ("html", "body", "main"):
        return mark
    names = [[w.lower() for w in _WORDS.findall(n)] for n in (found.get("class", "") + " " + found.get("id", "")).split()]
    words = {w for n in names if n and n[0] not in NOT_WORDS for w in n}
    if words & ASIDE_WORDS and not (words & ASIDE_WORDS == {"header"} and inside >= MAIN):
        return DROP
    return mark if mark is not None else CONTENT if words & CONTENT_WORDS else None


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, mark) of each block of a page that has text."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    mark, start, size = OPEN, 0, len(page)

    def put(text: str) -> None:
        if text:
            parts.append(html.unescape(text) if "&" in text else text)

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, mark))

    def close(names: set[str] | frozenset[str], scope: bool) -> None:
        """Close the innermost open element of these names, and all in it; ``scope``: not beyond another block."""
        nonlocal mark
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                mark = stack[k][1]
                for name, _ in stack[k:]:
                    opened[name] -= 1
                del stack[k:]
                return
            if scope and stack[k][0] in BLOCK:
                return

    while start < size:
        m = _TAG.search(page, start)
        if m is None:
            put(page[start:])
            break
        put(page[start : m.start()])
        start = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ends = name.lower(), (m[1] or m[4]) == "/"
        if tag in RAW and not ends:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, start)
            start = stop.end() if stop else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK
        if block:
            end_block()
        if ends:
            close({tag}, False)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            close(CLOSES[tag], tag not in ("tr", "td", "th"))
        elif block:
            close({"p"}, True)
        own = None if mark == DROP else _marked(tag, m[3] if m[2] else m[6], mark)
        stack.append((tag, mark))
        opened[tag] += 1
        if own is not None:
            mark = DROP if own == DROP else max(mark, own)
    end_block()
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, by bit-parallel dynamic programming."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    both = set(a[first : len(a) - last]) & set(b[first : len(b) - last])
    at_a = [k for k in range(first, len(a) - last) if a[k] in both]
    at_b = [k for k in range(first, len(b) - last) if b[k] in both]
    inner = _aligned([a[k] for k in at_a], [b[k] for k in at_b]) if both else []
    ends = [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]
    return [*((k, k) for k in range(first)), *((at_a[i], at_b[j]) for i, j in inner), *ends]


def _rows(a: list, b: list):
    """After each element of b, the places of a where the common length does not grow, as bits."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_CELLS and len(b) > 1:
        half, lengths = len(b) // 2, []
        for x, y in ((a, b[:half]), (a[::-1], b[half:][::-1])):
            row = deque(_rows(x, y), maxlen=1).pop()
            flat = np.unpackbits(np.frombuffer(row.to_bytes(len(x) // 8 + 1, "little"), dtype="u1"), bitorder="little")[: len(x)]
            lengths.append(np.concatenate([[0], np.cumsum(1 - flat.astype(np.int64))]))
        cut = int((lengths[0] + lengths[1][::-1]).argmax())
        return _aligned(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in _aligned(a[cut:], b[half:])]
    rows, i, j, out = list(_rows(a, b)), len(a), len(b), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                out.append((i, j))
    return out[::-1]


class _Page:
    """A page in the window: line hashes, words, marks, and how often neighbours share each line."""

    __slots__ = ("row", "host", "guest", "hashes", "words", "marks", "votes", "sure")

    def __init__(self, row, host: str, guest: bool, hashes: np.ndarray, words: np.ndarray, marks: np.ndarray):
        self.row, self.host, self.guest, self.hashes, self.words, self.marks = row, host, guest, hashes.tolist(), words, marks
        self.votes, self.sure = np.zeros(len(hashes), dtype=np.int32), np.zeros(len(hashes), dtype=bool)

    def mostly(self, shared: np.ndarray) -> bool:
        """Whether the shared lines are all that the page has, or most of its long lines."""
        own = self.marks != DROP
        long = own & (self.words >= LONG_WORDS)
        return bool(shared[own].all()) or 2 * int(self.words[long & shared].sum()) > int(self.words[long].sum())

    def deleted(self) -> np.ndarray:
        return (self.sure | (self.votes > 1)) & (self.marks != ARTICLE)


def difference(one: _Page, two: _Page) -> None:
    """Note on two pages which lines they share."""
    pairs = common(one.hashes, two.hashes)
    if not pairs:
        return
    at = np.asarray(pairs)
    shared = [np.zeros(len(p.hashes), dtype=bool) for p in (one, two)]
    shared[0][at[:, 0]], shared[1][at[:, 1]] = True, True
    if one.mostly(shared[0]) or two.mostly(shared[1]):
        return
    run = np.concatenate([[0], np.cumsum((np.diff(at, axis=0) != 1).any(axis=1))])
    sure = np.bincount(run, weights=one.words[at[:, 0]])[run] >= RUN_WORDS
    for k, page in enumerate((one, two)):
        page.votes[at[:, k]] += 1
        page.sure[at[sure, k]] = True


KEY = ["host", "path", "id_key", "tie"]
DEALT = "range int, host string, path string, id_key long, tie long, guest boolean, page_id long, url string, hashes binary, words binary, marks binary, texts string"
RESULT = "page_id long, url string, text string, n_chars long, n_lines long, n_shared long"


def _keyed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.lower(F.regexp_extract(url, _URL, 1)).alias("host"), F.substring(F.regexp_extract(url, _URL, 2), 1, PATH_CHARS).alias("path"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("id_key"), F.xxhash64(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("tie"),
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def range_cuts(keyed: DataFrame, near: int) -> tuple[list, list, list]:
    """Keys at which ranges start, and those ``near`` pages behind and before each start; at most ``MOST_RANGES`` of each."""
    spark = keyed.sparkSession
    keys = materialise(keyed.select(*KEY, F.octet_length("html").cast("long").alias("_size")), "page-keys")
    total, rows = keys.agg(F.sum("_size"), F.count("*")).head()
    ranges = min(max(1, (total or 0) // RANGE_BYTES), MOST_RANGES)
    step = max(-(-(rows or 0) // ranges), 4 * near)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialise(keys.drop("_size").repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).withColumn("_at", F.monotonically_increasing_id()), "page-order")
    own, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(own.alias("p")).agg(F.count("*").alias("n")).collect())  # one for each partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    found = {}
    if offsets:
        table = spark.createDataFrame(offsets, "_p long, _before long")
        ranked = ordered.join(F.broadcast(table), own == F.col("_p")).withColumn("_rank", F.col("_before") + place)
        wanted = ranked.where((F.col("_rank") >= step - near) & (F.col("_rank") % step).isin(0, near, step - near))
        found = {r["_rank"]: (r["host"], r["path"], r["id_key"], r["tie"]) for r in wanted.select(*KEY, "_rank").collect()}
    discard(keys, ordered)
    starts = [r for r in sorted(found) if r % step == 0]
    return [found[r] for r in starts], [found.get(r + near) for r in starts], [found[r - near] for r in starts]


def _deal(cuts: tuple[list, list, list]):
    """Pages as lines, each to its range and, near an end of it, to the range beside it."""
    starts, behind, ahead = cuts
    names = [c.split()[0] for c in DEALT.split(", ")]

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in (*KEY, "page_id", "url")}
            for a, b, pages in text_blocks(batch.column("html")):
                own = {n: c.slice(a, b - a).to_pylist() for n, c in columns.items()}
                out: list[list] = [[] for _ in names]
                for k, page in enumerate(pages):
                    key = tuple(own[n][k] for n in KEY)
                    lines = page_lines(page)
                    hashes = np.asarray([hash_of(t) for t, _ in lines], dtype="<i8").tobytes()
                    words = np.asarray([t.count(" ") + 1 for t, _ in lines], dtype="<i4").tobytes()
                    marks = bytes(m for _, m in lines)
                    texts = "\n".join(t for t, m in lines if m)
                    at = bisect_right(starts, key)
                    places = [(at, False)]
                    if at and (behind[at - 1] is None or key < behind[at - 1]):
                        places.append((at - 1, True))
                    if at < len(starts) and key >= ahead[at]:
                        places.append((at + 1, True))
                    for place, guest in places:
                        row = (place, *key, guest, own["page_id"][k], None if guest else own["url"][k], hashes, words, marks, None if guest else texts)
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
                kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _main_text(page: _Page) -> tuple[str, int, int]:
    deleted, _, texts = page.deleted(), page.guest, page.row[2]
    shown = np.flatnonzero(page.marks != DROP)
    best = page.marks.max(initial=DROP)
    lines = texts.split("\n") if len(shown) else []
    kept = [lines[n] for n, k in enumerate(shown.tolist()) if page.marks[k] == best and not deleted[k]]
    return "\n\n".join(kept), len(page.hashes), int(deleted.sum())


def _diff(near: int):
    def run(batches):
        window: deque[_Page] = deque()
        out: list[tuple] = []
        here = None

        def leave() -> None:
            page = window.popleft()
            if not page.guest:
                text, lines, shared = _main_text(page)
                out.append((page.row[0], page.row[1], text, len(text), lines, shared))

        def batch_of():
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])
            out.clear()
            return done

        for batch in batches:
            own = {n: batch.column(n) for n in ("range", "host", "guest", "page_id", "url", "hashes", "words", "marks", "texts")}
            for k in range(batch.num_rows):
                row = {n: c[k].as_py() for n, c in own.items()}
                place = (row["range"], row["host"])
                if place != here:
                    while window:
                        leave()
                    here = place
                page = _Page(
                    (row["page_id"], row["url"], row["texts"]), row["host"], row["guest"], np.frombuffer(row["hashes"], dtype="<i8"), np.frombuffer(row["words"], dtype="<i4"),
                    np.frombuffer(row["marks"], dtype="u1"),
                )
                if page.host:
                    for other in window:
                        difference(other, page)
                window.append(page)
                if len(window) > near:
                    leave()
            yield batch_of()
        while window:
            leave()
        yield batch_of()

    return run


def main_texts(pages: DataFrame, near: int = NEAR) -> DataFrame:
    """page_id, url, text, n_chars, n_lines and n_shared (lines deleted because neighbours share them) of each page."""
    keyed = _keyed(pages)
    cuts = range_cuts(keyed, near)
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(cuts[0]) + 1, MOST_RANGES))
    dealt = keyed.mapInArrow(frugal(_deal(cuts)), DEALT)
    return dealt.repartition(parts, "range").sortWithinPartitions("range", *KEY).mapInArrow(frugal(_diff(near)), RESULT)


def op13_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(load(spark, sf_dir, "pages"))
