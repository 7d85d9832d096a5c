"""Export of approved requests: positions, limits, the payload, and what an answer of the receiver means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteproof.schema import ITEM_KEYS, LIMITS

# Exported header fields with their names in the payload, limits, statuses worth another try.
EXPORTED = {"company": "company", "contact_person": "contactPerson", "requested_delivery_date": "requestedDeliveryDate"}
ENVELOPE_BYTES, REFERENCE_SHAPE = 1024, r"^QR-[0-9A-F]{10}\z"
RETRYABLE = (408, 429, 500, 502, 503, 504)
_KEEP = {"ignoreNullFields": "false"}


def numbered(items: DataFrame, key: str = "request_id", order: str = "item_index") -> DataFrame:
    """``items`` with their 1-based ``position``."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def line_items(items: DataFrame, key: str = "request_id") -> DataFrame:
    """key, items: an array of (position, description, quantity, unit, material, dimensions) in order."""
    row = F.struct("position", *(F.col(k).cast("string").alias(k) for k in ITEM_KEYS))
    return numbered(items, key).groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("items"))


def limit_violations(subject: Column, fields: dict[str, Column], items: Column) -> Column:
    """Names of what the receiver would refuse: subject, header fields, `item N field`, lineItems, body. ``items`` may be null."""
    held = F.coalesce(items, F.array().cast(ITEMS))

    def named(name, fails: Column) -> Column:
        return F.when(F.coalesce(fails, F.lit(False)), name if isinstance(name, Column) else F.lit(name))

    def of_item(x: Column) -> Column:
        names = [named(F.concat(F.lit("item "), x["position"].cast("string"), F.lit(f" {k}")), F.char_length(x[k]) > LIMITS["field"]) for k in ITEM_KEYS]
        return F.filter(F.array(*names), lambda n: n.isNotNull())

    body = F.to_json(F.struct(subject.alias("subject"), F.array(*fields.values()).alias("values"), held.alias("items")), _KEEP)
    header = [named("subject", F.char_length(subject) > LIMITS["subject"]), *(named(k, F.char_length(v) > LIMITS["field"]) for k, v in fields.items())]
    whole = [named("lineItems", F.size(held) > LIMITS["items"]), named("body", F.octet_length(body) + ENVELOPE_BYTES > LIMITS["body"])]
    return F.concat(F.filter(F.array(*header), lambda n: n.isNotNull()), F.flatten(F.transform(held, of_item)), F.filter(F.array(*whole), lambda n: n.isNotNull()))


ITEMS = "array<struct<position:int," + ",".join(f"{k}:string" for k in ITEM_KEYS) + ">>"


def payload(request_id: Column, subject: Column, approved_at: Column, fields: dict[str, Column], items: Column) -> Column:
    """The JSON body: nulls are kept, lineItems only where there are any; null without an approval or above the size."""
    head = [
        request_id.alias("requestId"), subject.alias("subject"), F.date_format(approved_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("approvedAt"),
        F.struct(*(fields[k].cast("string").alias(name) for k, name in EXPORTED.items())).alias("fields"),
    ]
    with_items = F.to_json(F.struct(*head, items.alias("lineItems")), _KEEP)
    body = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, with_items).otherwise(F.to_json(F.struct(*head), _KEEP))
    return F.when(approved_at.isNotNull() & (F.octet_length(body) <= LIMITS["body"]), body)


def approvals(audit: DataFrame, key: str = "request_id") -> DataFrame:
    """key, approved_at: the last approval in the audit."""
    return audit.where("action = 'request.approved'").groupBy(key).agg(F.max("created_at").alias("approved_at"))


def outcome(status: Column, error: Column, body: Column, request_id: Column) -> Column:
    """struct(result, retryable, reference, replay) of an answer: an HTTP status and body, or a transport error.

    created, replay (the key was known); http, timeout, unreachable, contract_violation.
    """
    reference, told = F.get_json_object(body, "$.erpReference"), F.get_json_object(body, "$.requestId")
    good = F.coalesce((F.lower(told) == F.lower(request_id)) & (F.coalesce(reference, F.lit("")) != ""), F.lit(False))

    def result(name, retry, ref=None) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("result"), (F.lit(retry) if isinstance(retry, bool) else retry).alias("retryable"), (F.lit(None).cast("string") if ref is None else ref).alias("reference"))

    return (
        F.when(error.isNotNull(), result(F.when(error == "timeout", "timeout").otherwise("unreachable"), True))
        .when(~status.isin(200, 201), result("http", status.isin(*RETRYABLE)))
        .when(~good, result("contract_violation", False))
        .otherwise(result(F.when(status == 200, "replay").otherwise("created"), False, reference))
    )


def receiver(store: DataFrame, calls: DataFrame) -> DataFrame:
    """key, order, status of an idempotent receiver's answers: 201 for a new key, 200 for the same body, 409 for another.

    ``store``: key, body_hash known before; ``calls``: key, nth, body_hash in order.
    """
    every = store.select("key", F.lit(-1).alias("nth"), "body_hash").unionByName(calls.select("key", "nth", "body_hash"))
    first = F.first("body_hash").over(Window.partitionBy("key").orderBy("nth"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("nth"))
    status = F.when(F.col("body_hash") != first, 409).when(rank == 1, 201).otherwise(200)
    return every.withColumn("status", status).where("nth >= 0").select("key", "nth", "status")


def nth_smallest(rows: DataFrame, order: str, n: int, ranges: int = 4096) -> int | None:
    """The n-th smallest (from 1) of a column of unique whole numbers, or None of fewer: counted by ranges of one width, then
    within the range in which the n-th lies, until a range is one number. No task sorts or sees all rows."""
    low, high, total = rows.agg(F.min(order), F.max(order), F.count("*")).head()
    if n > total:
        return None
    while True:
        step = (high - low) // ranges + 1
        own = rows.where(F.col(order).between(low, high)).groupBy(F.expr(f"(`{order}` - {low}L) div {step}L").alias("range")).agg(F.count("*").alias("rows"))
        for r in sorted(own.collect()):  # one row a range
            if r["rows"] >= n:
                low, high = low + r["range"] * step, min(high, low + (r["range"] + 1) * step - 1)
                break
            n -= r["rows"]
        if step == 1:
            return low


def bounded_receiver(store: DataFrame, calls: DataFrame, most: int) -> DataFrame:
    """``receiver`` with a store of at most ``most`` keys, which keeps what it has: 503 for a call of a new key once it is full.

    ``nth`` orders all calls. The store never shrinks, so the keys that find room are the new ones that come first, and a
    key that has found none finds none later.
    """
    new = calls.join(store.select("key").distinct(), "key", "left_anti")
    firsts = new.groupBy("key").agg(F.min("nth").alias("nth"))
    room = most - store.select("key").distinct().count()
    last = nth_smallest(firsts, "nth", room) if room > 0 else -(2**63)
    late = firsts.where(F.col("nth") > F.lit(last)).select("key") if last is not None else firsts.limit(0).select("key")
    refused = calls.join(late, "key", "left_semi").select("key", "nth", F.lit(503).alias("status"))
    return receiver(store, calls.join(late, "key", "left_anti")).unionByName(refused)
