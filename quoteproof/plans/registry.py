"""Registered queries on the supplied tables, each with the SQL that says the same.

The tables are not those of a quote-intake application, so each query keeps an operator and changes the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoteproof.functions import values
from quoteproof.functions.dealing import parts_for
from quoteproof.functions.grammar import UNITS
from quoteproof.functions.html import visible_text
from quoteproof.operators import extraction, grounding, intake, lifecycle, requests
from quoteproof.plans import application  # noqa: F401  registers its queries
from quoteproof.plans.base import ORACLES, QUERIES, query, t
from quoteproof.session import shared_folder
from quoteproof.sources.clustered import ClusteredList


def lines(docs: DataFrame) -> DataFrame:
    """Non-empty lines with their 1-based number, empty ones counted."""
    exploded = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("p", "raw"))
    return exploded.select("doc_id", "lang", (F.col("p") + 1).cast("long").alias("line"), values.collapsed(F.col("raw")).alias("text")).where("text != ''")


@query(r"""SELECT doc_id, CAST(i AS BIGINT) AS line, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''""")
def line_segments(spark, d):
    return lines(t(spark, d, "documents")).select("doc_id", "line", "text")


def quotes_in_documents(spark, d) -> DataFrame:
    """Which benchmark quotes stand in which document; see ``grounding.quoted_in``."""
    docs = t(spark, d, "documents").select("doc_id", "lang", values.lower_folded(F.col("text")).alias("text"))
    items = t(spark, d, "benchmark").select("item_id", values.lower_folded(F.col("text")).alias("quote")).where("quote != ''")
    return grounding.quoted_in(docs, items, "doc_id", "item_id").select("doc_id", "lang", "item_id")


_FOLDED = r"replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), 'ß', 'ss')"
_GROUNDED = f"""SELECT doc_id, lang, item_id FROM documents JOIN benchmark ON contains({_FOLDED.format('documents.text')}, {_FOLDED.format('benchmark.text')})"""


@query(f"SELECT doc_id, item_id FROM ({_GROUNDED})")
def quote_in_segment(spark, d):
    return quotes_in_documents(spark, d).select("doc_id", "item_id")


@query(f"SELECT lang, count(*) AS n_quotes, count(DISTINCT doc_id) AS n_documents FROM ({_GROUNDED}) GROUP BY lang")
def grounded_by_language(spark, d):
    return quotes_in_documents(spark, d).groupBy("lang").agg(F.count("*").alias("n_quotes"), F.countDistinct("doc_id").alias("n_documents"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'X') AS n_unknown FROM orders")
def status_summary(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(s == "O").alias("n_open"), F.count_if(s == "X").alias("n_unknown"))


def _orders_of_nation(spark, d, nation):
    customers = t(spark, d, "customer").where(F.col("c_nationkey") == nation).select("c_custkey")
    return t(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
def keyset_page_first(spark, d):
    return intake.keyset_page(_orders_of_nation(spark, d, 7), "o_orderdate", "o_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7),
c AS (SELECT o_orderdate AS a, o_orderkey AS k FROM o ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 49)
SELECT o_orderkey, o_orderdate FROM o, c WHERE (o_orderdate, o_orderkey) < (a, k) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
def keyset_page_next(spark, d):
    rows = _orders_of_nation(spark, d, 7)
    page = intake.keyset_page(rows, "o_orderdate", "o_orderkey").collect()  # one page
    last = page[49] if len(page) > 50 else None
    return intake.keyset_page(rows, "o_orderdate", "o_orderkey", (last["o_orderdate"], last["o_orderkey"])) if last else rows.limit(0)


@query("""WITH o AS (SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7),
p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM o) SELECT CAST((n - 1) // 50 AS INT) AS page, o_orderkey, o_orderdate FROM p WHERE n <= 150""")
def clustered_pages(spark, d):
    """The first three pages of a nation's orders, walked by cursors over a clustered copy of all orders."""
    customers = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = t(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", "o_orderdate")
    table = ClusteredList(spark, shared_folder(spark, "clustered"), "c_nationkey", "o_orderdate", "o_orderkey")
    table.write(orders, 32)
    pages, cursor = None, None
    for n in range(3):
        page = table.page(7, cursor)
        rows = page.limit(50).select(F.lit(n).alias("page"), "o_orderkey", "o_orderdate")
        pages = rows if pages is None else pages.union(rows)
        seen = page.collect()  # one page
        if len(seen) <= 50:
            break
        cursor = (seen[49]["o_orderdate"], seen[49]["o_orderkey"])
    return pages


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filtered_list(spark, d):
    return intake.filtered(t(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


def _latest_orders(spark, d):
    return grounding.latest(t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


_LATEST = "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@query(f"SELECT o_custkey, o_orderkey, o_orderdate FROM ({_LATEST})")
def latest_per_entity(spark, d):
    return _latest_orders(spark, d).select("o_custkey", "o_orderkey", "o_orderdate")


@query(f"""SELECT o_custkey, o_orderkey, count(l_orderkey) AS n_items, coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT AS quantity
FROM ({_LATEST}) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def latest_with_items(spark, d):
    joined = _latest_orders(spark, d).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("o_custkey", "o_orderkey").agg(F.count("l_orderkey").alias("n_items"), F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("quantity"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'missing' WHEN o_orderstatus = 'F' THEN 'found' WHEN o_orderstatus = 'O' THEN 'uncertain' ELSE 'unverified' END AS status FROM orders)
SELECT o_custkey, CASE WHEN status <> 'missing' THEN o_orderkey END AS o_orderkey, status FROM f
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE status WHEN 'found' THEN 3 WHEN 'uncertain' THEN 2 WHEN 'unverified' THEN 1 ELSE 0 END DESC, o_orderkey) = 1""")
def rank_merge(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(F.col("o_custkey") % 4 == 0, "missing").when(s == "F", "found").when(s == "O", "uncertain").otherwise("unverified")
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", status.alias("status"))
    return grounding.rank_merge(rows, ["o_custkey"], grounding.status_rank(F.col("status")), [F.col("o_orderkey")], "o_orderkey")


@query("""WITH i AS (SELECT DISTINCT o_custkey, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) - 1 AS item_index FROM i""")
def renumber_items(spark, d):
    lines = t(spark, d, "lineitem")
    parts = parts_for(lines)
    met = lines.repartition(parts, "l_orderkey").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = met.select("o_custkey", "l_orderkey", "l_linenumber").distinct().repartition(parts, "o_custkey")
    return grounding.renumber(items, ["o_custkey"], [F.col("l_orderkey"), F.col("l_linenumber")]).withColumn("item_index", F.col("item_index").cast("long"))


@query("""WITH k AS (SELECT doc_id, 'a' AS s, sha256(text) AS k FROM documents UNION ALL SELECT doc_id, 'b', source || ':' || n_chars FROM documents WHERE source IS NOT NULL),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s, k ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first FROM k)
SELECT doc_id, min(first) AS duplicate_of FROM f GROUP BY 1""")
def duplicate_flags(spark, d):
    docs = t(spark, d, "documents")
    keys = [F.sha2(F.col("text").cast("binary"), 256), F.concat_ws(":", F.when(F.col("source").isNotNull(), F.col("source")), F.col("n_chars"))]
    return intake.first_earlier(docs, "doc_id", ["doc_id"], keys)


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_name, c_custkey")
def members_users(spark, d):
    joined = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "c_name", "n_name").orderBy("c_name", "c_custkey")


_STEPS = (("login", "NEW", "OPEN"), ("view", "OPEN", "OPEN"), ("click", "OPEN", "ACTIVE"), ("view", "ACTIVE", "ACTIVE"), ("click", "ACTIVE", "ACTIVE"),
          ("purchase", "ACTIVE", "DONE"), ("logout", "OPEN", "NEW"), ("logout", "ACTIVE", "NEW"), ("login", "DONE", "OPEN"))
_SQL_STEPS = " ".join(f"WHEN split_part(x, '|', 1) || '|' || e = '{a}|{k}' THEN '{b}'" for k, a, b in _STEPS)


@query(f"""WITH l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS es FROM events GROUP BY 1),
f AS (SELECT user_id, list_reduce(es, lambda x, e: CASE {_SQL_STEPS.replace("THEN '", "THEN '").replace("' WHEN", "' || '|' || split_part(x, '|', 2) WHEN")} || '|' || split_part(x, '|', 2)
 ELSE split_part(x, '|', 1) || '|' || (CAST(split_part(x, '|', 2) AS INT) + 1) END, 'NEW|0') AS r FROM l)
SELECT user_id, split_part(r, '|', 1) AS status, CAST(split_part(r, '|', 2) AS BIGINT) AS illegal_steps FROM f""")
def status_fold(spark, d):
    return intake.fold(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "NEW", _STEPS)


@query("""WITH o AS (SELECT user_id, count(*) AS a, bool_or(event_type = 'purchase') AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT user_id, count(*) AS a, bool_or(event_type = 'purchase') AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(o.user_id, b.user_id) AS user_id, CAST(coalesce(o.a, 0) + CASE WHEN coalesce(o.s, false) THEN 0 ELSE coalesce(b.a, 0) END AS BIGINT) AS attempts,
CASE WHEN coalesce(o.s, false) OR coalesce(b.s, false) THEN 'succeeded' ELSE 'pending' END AS status FROM o FULL JOIN b ON o.user_id = b.user_id""")
def ledger_upsert(spark, d):
    """The stream's even and odd events stand for the ledger's history and the batch."""
    ev = t(spark, d, "events").withColumn("succeeded", F.col("event_type") == "purchase")
    old = ev.where("event_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("attempts"), F.when(F.bool_or("succeeded"), "succeeded").otherwise("pending").alias("status"))
    return intake.upsert_ledger(old, ev.where("event_id % 2 = 1"), "user_id")


@query("""WITH k AS (SELECT conv_id, arg_min(sha256(text), turn) AS h FROM conversations GROUP BY 1)
SELECT c.conv_id, any_value(h) AS first_hash, bool_or(sha256(text) <> h) AS conflict FROM conversations c JOIN k ON c.conv_id = k.conv_id GROUP BY 1""")
def idempotent_sink(spark, d):
    rows = t(spark, d, "conversations").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    return rows.groupBy("conv_id").agg(F.min_by("h", "turn").alias("first_hash"), (F.min("h") != F.max("h")).alias("conflict"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def number_roundtrip(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole = F.regexp_replace(F.floor(cents / 100).cast("long").cast("string"), r"(?<=\d)(?=(\d{3})+$)", ".")
    shown = F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Preis "), shown, F.lit(" EUR")).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", F.round(values.numbers_in(F.col("s"))[0] * 100).cast("long").alias("cents"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS found FROM orders")
def date_roundtrip(spark, d):
    s = F.concat(F.lit("Lieferung bis "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" erbeten."))
    return t(spark, d, "orders").select("o_orderkey", values.days_in(s)[0].alias("found"))


@query("SELECT o_orderkey, CAST(week(o_orderdate) AS INT) AS week, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def week_roundtrip(spark, d):
    s = F.concat(F.lit("Termin KW "), F.weekofyear("o_orderdate"), F.lit("/"), F.year("o_orderdate"))
    return t(spark, d, "orders").select("o_orderkey", values.weeks_in(s)[0].alias("w")).select("o_orderkey", "w.week", "w.year")


_SPELLED = list(UNITS.items())


@query("SELECT p_partkey, (CASE p_partkey % %d %s END) AS unit FROM part".replace("%d", str(len(_SPELLED))).replace("%s", " ".join(f"WHEN {k} THEN '{u}'" for k, (_, u) in enumerate(_SPELLED))))
def unit_canonical(spark, d):
    spelling = F.element_at(F.array(*(F.lit(s) for s, _ in _SPELLED)), (F.col("p_partkey") % len(_SPELLED) + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", values.unit(F.concat(F.lit(" "), F.upper(spelling), F.lit(". "))).alias("unit"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s@<>]+@[^\s@<>]+\.[^\s@<>]+')) AS n_mails FROM documents""")
def mail_shapes(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"(?U)[^\s@<>]+@[^\s@<>]+\.[^\s@<>]+"), F.lit(0)))
    return t(spark, d, "documents").select("doc_id", n.cast("long").alias("n_mails"))


_BREAKS = "address|article|blockquote|br|dd|div|dl|dt|footer|h1|h2|h3|h4|h5|h6|header|hr|li|ol|p|pre|section|table|td|th|tr|ul"


@query(rf"""WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<title[^>]*>.*?</title\s*>|<!--.*?-->', '', 'g') AS x FROM pages),
h AS (SELECT page_id, regexp_replace(x, '(?is)<head(\s[^>]*)?>.*?</head\s*>', '', 'g') AS x FROM s),
b AS (SELECT page_id, regexp_replace(x, '(?i)</?({_BREAKS})(\s[^>]*)?/?>', chr(10), 'g') AS x FROM h), g AS (SELECT page_id, regexp_replace(x, '<[!/]?[a-zA-Z][^>]*>', '', 'g') AS x FROM b),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&') AS x FROM g),
l AS (SELECT page_id, list_filter(list_transform(string_split_regex(x, '\r\n|\r|\n'), lambda y: trim(regexp_replace(y, '[\s\p{{Z}}]+', ' ', 'g'))), lambda y: y <> '') AS ls FROM u)
SELECT page_id, array_to_string(ls, chr(10)) AS text FROM l""")
def html_text(spark, d):
    return t(spark, d, "pages").select("page_id", visible_text(F.col("html")).alias("text"))


@query(f"SELECT DISTINCT doc_id FROM ({_GROUNDED})")
def injection_semi(spark, d):
    return quotes_in_documents(spark, d).select("doc_id").distinct()


@query("""SELECT 'status vocabulary' AS rule, count(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'found implies quote', count(*) FROM documents WHERE n_chars > 0 AND text IS NULL
UNION ALL SELECT 'quantity not negative', count(*) FROM lineitem WHERE l_quantity < 0
UNION ALL SELECT 'line unique', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'order has customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'append only', count(*) FROM (SELECT event_id FROM events WHERE event_id % 2 = 0 EXCEPT SELECT event_id FROM events)""")
def constraint_report(spark, d):
    orders, items, ev = t(spark, d, "orders"), t(spark, d, "lineitem"), t(spark, d, "events").select("event_id")
    return intake.violations([
        ("status vocabulary", orders.where(~F.col("o_orderstatus").isin("F", "O"))),
        ("found implies quote", t(spark, d, "documents").where("n_chars > 0 and text is null")),
        ("quantity not negative", items.where("l_quantity < 0")),
        ("line unique", items.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
        ("order has customer", orders.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("append only", ev.where("event_id % 2 = 0").exceptAll(ev)),
    ])


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_nationkey IN (3, 7) GROUP BY 1")
def tenant_scope(spark, d):
    from quoteproof.session import TenantSession

    scopes = [TenantSession(lambda name: t(spark, d, name), tenant, "c_nationkey", r"^\d+$").table("customer") for tenant in (3, 7, None, "x' or 1=1")]
    rows = scopes[0]
    for s in scopes[1:]:
        rows = rows.union(s)
    return rows.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


_TENANT = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey", "orders": "o_nationkey", "lineitem": "l_nationkey", "events": "nationkey"}
_HELD = {"customer", "supplier", "nation"}


@query(" UNION ALL ".join(
    f"""SELECT '{name}' AS "table", (SELECT count(*) FROM information_schema.columns WHERE table_name = '{name}') AS columns, '{column}' AS tenant_column,
    EXISTS (SELECT 1 FROM information_schema.columns WHERE table_name = '{name}' AND column_name = '{column}') AS has_tenant, (SELECT count(*) FROM {name}) AS n_rows,
    {f"(SELECT count(*) FROM {name} WHERE {column} IS NULL)" if name in _HELD else f"(SELECT count(*) FROM {name})"} AS n_without FROM (SELECT 1)""" for name, column in _TENANT.items()))
def table_policies(spark, d):
    """Which tables carry their tenant, and how many of their rows no tenant would see; nations stand for tenants."""
    return lifecycle.table_policies({name: (t(spark, d, name), column) for name, column in _TENANT.items()})


@query("""WITH g AS (SELECT o_custkey, k, k - row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS g FROM (SELECT DISTINCT o_custkey, o_orderkey // 1000 AS k FROM orders))
SELECT o_custkey, min(k) AS first, max(k) AS last, count(*) AS length FROM g GROUP BY o_custkey, g""")
def page_runs(spark, d):
    return intake.islands(t(spark, d, "orders").select("o_custkey", F.expr("o_orderkey div 1000").alias("k")), "o_custkey", "k")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1")
def audit_last(spark, d):
    rows = t(spark, d, "events").where("event_type = 'purchase'")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("""SELECT role, action, CASE WHEN role = 'user' THEN action = 'requests.process' WHEN role = 'assistant' THEN action IN ('requests.process', 'requests.ingest')
WHEN role = 'system' THEN true ELSE false END AS allowed FROM (SELECT DISTINCT role FROM conversations), (VALUES ('requests.process'), ('requests.ingest'), ('users.invite')) v(action)""")
def permissions(spark, d):
    """Speakers stand for the application's roles."""
    names = F.when(F.col("role") == "user", "guest").when(F.col("role") == "assistant", "clerk").when(F.col("role") == "system", "admin")
    rows = t(spark, d, "conversations").select("role").distinct().withColumn("actor", names)
    rows = rows.withColumn("action", F.explode(F.array(F.lit("requests.process"), F.lit("requests.ingest"), F.lit("users.invite"))))
    return rows.select("role", "action", requests.permitted(F.col("actor"), F.col("action")).alias("allowed"))


#: Claims on every line: its second word, or a mail address or number of it, in turn; cited rightly, reversed, or elsewhere.
CLAIM = {
    "field_key": "CASE (doc_id + line) % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'quantity' ELSE 'company' END",
    "status": "CASE WHEN (doc_id + 2 * line) % 7 = 0 THEN 'uncertain' WHEN (doc_id + line) % 17 = 0 THEN 'missing' ELSE 'found' END",
    "segment_id": "CASE WHEN (3 * doc_id + line) % 19 = 0 THEN NULL WHEN (doc_id + 3 * line) % 11 = 0 THEN 'l0' ELSE concat('l', CAST(line AS STRING)) END",
    "quote": "CASE WHEN (3 * doc_id + line) % 19 = 0 THEN NULL WHEN (doc_id + 5 * line) % 13 = 0 THEN concat('nicht ', text) WHEN (doc_id + line) % 23 = 0 THEN ' ' ELSE text END",
}
_CLAIMED = ", ".join(f"{e} AS {k}" for k, e in CLAIM.items())


@query(rf"""WITH s AS (SELECT doc_id, i AS line, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
c AS (SELECT doc_id, line, text, {_CLAIMED} FROM s WHERE text <> ''),
k AS (SELECT *, CASE field_key WHEN 'email' THEN nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+', 0), '') WHEN 'quantity' THEN nullif(regexp_extract(text, '(^| )([0-9]+)( |$)', 2), '') ELSE string_split(text, ' ')[least(2, len(string_split(text, ' ')))] END AS value FROM c),
n AS (SELECT *, replace(lower(trim(quote)), 'ß', 'ss') AS q, replace(lower(text), 'ß', 'ss') AS n, replace(lower(value), 'ß', 'ss') AS v, segment_id IS NULL AS bare FROM k),
f AS (SELECT *, CASE field_key WHEN 'company' THEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(v) || '($|[^\p{{L}}\p{{N}}_])') WHEN 'email' THEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_.+-])' || regexp_escape(lower(value)) || '($|[^\p{{L}}\p{{N}}_.-]|\.$|\.[^\p{{L}}\p{{N}}_])') ELSE true END AS ok,
CASE field_key WHEN 'email' THEN lower(value) WHEN 'quantity' THEN coalesce(nullif(ltrim(value, '0'), ''), CASE WHEN value IS NOT NULL THEN '0' END) ELSE value END AS shown FROM n),
r AS (SELECT *, CASE WHEN status = 'missing' AND value IS NOT NULL THEN 'missing_with_value' WHEN status = 'missing' THEN '-' WHEN bare AND status = 'found' THEN 'no_evidence' WHEN bare THEN 'kept' WHEN value IS NULL AND status = 'found' THEN 'no_value' WHEN segment_id = 'l0' THEN 'unknown_segment' WHEN q = '' THEN 'empty_quote'
WHEN NOT contains(n, q) THEN 'quote_not_in_segment' WHEN value IS NULL THEN 'kept' WHEN NOT ok THEN 'value_not_in_quote' WHEN line % 5 = 0 AND status = 'found' THEN 'ocr_only' ELSE 'normal' END AS rule FROM f)
SELECT CAST(doc_id AS VARCHAR) AS document_id, field_key, CAST(line AS INT) AS item_index, CASE WHEN rule IN ('ocr_only', 'normal') THEN shown WHEN rule = '-' THEN NULL ELSE value END AS value,
CASE rule WHEN '-' THEN 'missing' WHEN 'kept' THEN status WHEN 'normal' THEN status WHEN 'ocr_only' THEN 'uncertain' ELSE 'unverified' END AS status,
status AS model_status, CASE WHEN rule NOT IN ('-', 'kept', 'normal') THEN rule END AS reason, CASE WHEN rule <> '-' THEN segment_id END AS segment_id, CASE WHEN rule <> '-' THEN quote END AS quote FROM r""")
def verified_claims(spark, d):
    """The rule chain on claims made from the documents' own lines."""
    segments = lines(t(spark, d, "documents"))
    words = F.split("text", " ")
    mail, count = F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+", 0), F.regexp_extract("text", "(^| )([0-9]+)( |$)", 2)
    claims = segments.select("doc_id", "line", "text", *(F.expr(e).alias(k) for k, e in CLAIM.items()))
    value = F.when(F.col("field_key") == "email", F.nullif(mail, F.lit(""))).when(F.col("field_key") == "quantity", F.nullif(count, F.lit(""))).otherwise(F.element_at(words, F.least(F.lit(2), F.size(words))))
    document = F.col("doc_id").cast("string").alias("document_id")
    claims = claims.select(document, "field_key", F.col("line").cast("int").alias("item_index"), value.alias("value"), "status", "segment_id", "quote")
    return grounding.verify(claims, segments.select(document, F.concat(F.lit("l"), "line").alias("segment_id"), "text", (F.col("line") % 5 == 0).alias("ocr")))


@query(r"""WITH l AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> '' GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_segments, n IS NOT NULL AS model_called, concat_ws(',', CASE WHEN n IS NULL THEN 'no_text' END, CASE WHEN d.doc_id % 7 = 0 THEN 'attachment_failed' END, CASE WHEN d.doc_id % 11 = 0 THEN 'ocr_pages_skipped' END) AS warnings,
CAST(CASE WHEN n IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_found, CAST(CASE WHEN n IS NULL THEN 6 ELSE 5 END AS BIGINT) AS n_missing FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id""")
def extraction_runs(spark, d):
    """Whole runs: a company is claimed of each document, cited from its first line; documents without text claim nothing."""
    docs = t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), "text", "lang")
    segments = lines(docs).select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("l"), "line").alias("segment_id"), "text", F.lit(False).alias("ocr"), "line")
    first = segments.groupBy("document_id").agg(F.min_by("text", "line").alias("quote"), F.min("line").alias("line"))
    claims = docs.select("document_id").join(first, "document_id", "left").select(
        "document_id", F.lit("company").alias("field_key"), F.lit(None).cast("int").alias("item_index"), F.coalesce("quote", F.lit("nothing")).alias("value"), F.lit("found").alias("status"),
        F.concat(F.lit("l"), F.col("line").cast("string")).alias("segment_id"), "quote",
    )
    number = F.col("doc_id")
    reports = docs.select("document_id", F.when(number % 7 == 0, "failed").otherwise("parsed").alias("status"))
    skipped = docs.select("document_id", F.when(number % 11 == 0, 3).otherwise(0).alias("pages"))
    found = extraction.fields(docs, segments, claims).groupBy("document_id").agg(F.count_if(F.col("status") == "found").alias("n_found"), F.count_if(F.col("status") == "missing").alias("n_missing"))
    done = extraction.runs(docs, segments, reports, skipped).join(found, "document_id")
    return done.select(F.col("document_id").cast("long").alias("doc_id"), "n_segments", "model_called", F.concat_ws(",", "warnings").alias("warnings"), "n_found", "n_missing")
