"""The request list and its rows: cursors, predicates, views, duplicates, members and limits of intake."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteproof.functions.runs import last_key, run_starts
from quoteproof.schema import PERMISSIONS

UUID = r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
REQUEST_ID = "id"


def parse_cursor(raw: Column) -> Column:
    """A UUID in lower case; null for anything else."""
    return F.when(F.lower(raw).rlike(rf"^{UUID}\z"), F.lower(raw))


def anchor(rows: DataFrame, cursor: str | None, at: str = "created_at", key: str = REQUEST_ID) -> tuple | None:
    """The (at, key) of the cursor's row among the tenant's rows; None (first page) where it is no id, unknown or foreign."""
    import re

    if not isinstance(cursor, str) or not re.fullmatch(UUID, cursor.lower()):
        return None
    found = rows.where(F.col(key) == cursor.lower()).select(at, key).head()
    return tuple(found) if found else None


def among(rows: DataFrame, column: str, wanted: list) -> DataFrame:
    """Rows whose column is one of the values; none of an empty list, without a scan."""
    return rows.where(F.col(column).isin(*wanted)) if wanted else rows.limit(0)


def same_text(column: Column, wanted: str) -> Column:
    """Equal after trimming, whatever the case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+\z", "")) == F.lit(wanted.strip().lower())


def since(rows: DataFrame, at: str, start, key: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows from a time on whose key starts with a prefix; both are pushed to the scan."""
    rows = rows.where(F.col(at) >= F.lit(start))
    return rows if prefix is None else rows.where(F.startswith(key, F.lit(prefix)))


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    """Descending with nulls first, as the index that serves it has them."""
    return rows.orderBy(F.col(at).desc_nulls_first(), F.col(key).desc())


def all_documents(*lists: DataFrame) -> DataFrame:
    """The documents of several lists as one bag: one listed twice stays twice; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


# --- one row's state


def sample_leftover(status: Column, source: Column, error_stage: Column) -> Column:
    """A sample that a broken run left behind."""
    open_ = status.isin("NEW", "PROCESSING") | ((status == "ERROR") & F.coalesce(error_stage == "processing", F.lit(False)))
    return (source == "sample") & open_


def duplicate_decidable(status: Column, error_stage: Column) -> Column:
    return status.isin("NEW", "REVIEW") | ((status == "ERROR") & F.coalesce(error_stage == "processing", F.lit(False)))


def row_view(status: Column, attempts: Column, error_stage: Column, error: Column, retry_at: Column, export_attempts: Column, export_error: Column) -> Column:
    """struct(attempts, stage, error, next_retry_at): what the list says of a row; the export columns are null without one."""

    def view(n: Column, stage: Column, cause: Column, retry: Column) -> Column:
        return F.struct(n.cast("long").alias("attempts"), stage.cast("string").alias("stage"), cause.cast("string").alias("error"), retry.alias("next_retry_at"))

    none = F.lit(None)
    no_time = F.when(F.lit(False), retry_at)
    in_export = F.coalesce(error_stage == "export", F.lit(False))
    failed = view(F.when(in_export, F.coalesce(export_attempts, attempts)).otherwise(attempts), F.when(in_export, "export").otherwise("processing"), error, no_time)
    return (
        F.when(status == "ERROR", failed)
        .when(status.isin("NEW", "PROCESSING") & (F.coalesce(error, F.lit("")) != ""), view(attempts, F.lit("processing"), error, retry_at))
        .when((status == "APPROVED") & (F.coalesce(export_error, F.lit("")) != ""), view(export_attempts, F.lit("export"), export_error, retry_at))
        .otherwise(view(attempts, none, none, no_time))
    )


# What the list and the notice say.
LABELS = {"decide": "Duplikat entscheiden", "review": "Prüfen", "retry": "Wartet auf neuen Versuch", "running": "Wird ausgewertet", "export_retry": "Export wird wiederholt", "export": "Export läuft", "error": "Fehler ansehen"}


def next_action(status: Column, possible_duplicate: Column, decision: Column, error: Column, export_error: Column) -> Column:
    """struct(label, kind): todo or waiting; null where nothing is left. An undecided duplicate comes before its review."""
    undecided = possible_duplicate & decision.isNull()
    failed, export_failed = (F.coalesce(x, F.lit("")) != "" for x in (error, export_error))

    def action(name: str, kind: str) -> Column:
        return F.struct(F.lit(LABELS[name]).alias("label"), F.lit(kind).alias("kind"))

    return (
        F.when(status.isin("NEW", "REVIEW") & undecided, action("decide", "todo")).when(status == "REVIEW", action("review", "todo"))
        .when(status.isin("NEW", "PROCESSING"), F.when(failed, action("retry", "waiting")).otherwise(action("running", "waiting")))
        .when(status == "APPROVED", F.when(export_failed, action("export_retry", "waiting")).otherwise(action("export", "waiting")))
        .when(status == "ERROR", action("error", "todo"))
    )


def processing_notice(status: Column, view: Column, now: Column, time_format: str = "yyyy-MM-dd HH:mm") -> Column:
    """struct(tone, text) for a request being processed, from its ``row_view``; the time is a parameter."""
    n, retry = view["attempts"], view["next_retry_at"]
    tries = F.concat(F.lit("Bisher "), n.cast("string"), F.when(n == 1, " Versuch.").otherwise(" Versuche."))
    at = F.concat(F.date_format(retry, time_format), F.lit("."))
    further = F.when(retry.isNull(), "").when(retry <= now, F.concat(F.lit(" Nächster Versuch fällig seit "), at)).otherwise(F.concat(F.lit(" Nächster Versuch: "), at))
    warning = F.struct(F.lit("warning").alias("tone"), F.concat(F.lit("Letzter Versuch fehlgeschlagen: "), view["error"], F.lit(" "), tries, further).alias("text"))
    info = F.struct(F.lit("info").alias("tone"), F.lit("Die Dokumente werden gerade ausgewertet.").alias("text"))
    return F.when(status.isin("NEW", "PROCESSING") & view["error"].isNotNull(), warning).when(status == "PROCESSING", info)


# --- counts and choices


def start_counts(rows: DataFrame) -> DataFrame:
    """total, review, error of the start page; 0 where there are none."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "REVIEW").alias("review"), F.count_if(F.col("status") == "ERROR").alias("error"))


def sample_for_visitors(rows: DataFrame, at: str = "created_at") -> DataFrame:
    """The newest sample in review, else the newest exported one."""
    place = F.when(F.col("status") == "REVIEW", 0).when(F.col("status") == "EXPORTED", 1)
    return rows.where((F.col("source") == "sample") & place.isNotNull()).orderBy(place, F.col(at).desc(), F.col(REQUEST_ID).desc()).limit(1)


def _admitted(keys: list[str], cap: int, span: int, names: list[str]):
    """Runs over rows sorted by key and time, and keeps the last ``cap`` accepted times of the current key."""

    def run(batches):
        before, kept = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            starts = np.flatnonzero(run_starts(columns, before))
            before = last_key(columns)
            times = batch.column("_t").to_numpy()
            counts, accepted = np.zeros(len(times), dtype=np.int64), np.zeros(len(times), dtype=bool)
            edges = np.unique(np.concatenate([[0], starts, [len(times)]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a or (len(starts) and starts[0] == 0):
                    kept = np.zeros(0, dtype=np.int64)
                t, taken = times[a:b], kept.tolist()
                at = 0
                while cap > 0 and at < len(t):
                    if len(taken) >= cap:
                        # the next one is the first that has left the hour behind the cap-th last accepted
                        at = max(at, int(np.searchsorted(t, taken[-cap] + span, side="right")))
                        if at == len(t):
                            break
                    taken.append(int(t[at]))
                    accepted[a + at] = True
                    at += 1
                own = np.asarray(taken, dtype=np.int64)
                mine = accepted[a:b]
                counts[a:b] = len(kept) + np.cumsum(mine) - mine - np.searchsorted(own, t - span)
                kept = own[-cap:] if cap > 0 else own
            extra = {"before": pa.array(counts, pa.int64()), "refused": pa.array(~accepted)}
            yield pa.RecordBatch.from_arrays([extra[n] if n in extra else batch.column(n) for n in names], names=names)

    return run


def within_cap(events: DataFrame, keys: list[str], at: str, order: str, cap: int, hours: int = 1) -> DataFrame:
    """``events`` with ``before``, the accepted events of the same key (tenant, person) in the trailing hours, and ``refused``
    from the cap on. A refused event is never stored, so it does not count against later ones.

    Events further apart than the trailing time do not see each other, so a key is cut into visits at such gaps (found
    on its hours, which are few), and visits are dealt out and run through as sorted streams with the last ``cap`` accepted
    times as their state. Events without a key or time are never counted.
    """
    span = hours * 3_600_000_000
    out = T.StructType([*events.schema.fields, T.StructField("before", T.LongType()), T.StructField("refused", T.BooleanType())])
    sound = reduce(lambda c, k: c & F.col(k).isNotNull(), keys, F.col(at).isNotNull())
    timed = events.where(sound).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_hour", F.floor(F.col("_t") / span))
    spans = timed.groupBy(*keys, "_hour").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    by_hour = Window.partitionBy(*keys).orderBy("_hour")
    apart = F.coalesce(F.col("_first") - F.lag("_last").over(by_hour) > span, F.lit(False))
    visits = spans.withColumn("_apart", apart.cast("int")).withColumn("_visit", F.sum("_apart").over(by_hour)).select(*keys, "_hour", "_visit")
    dealt = timed.join(visits, [*keys, "_hour"]).repartition(*keys, "_visit").sortWithinPartitions(*keys, "_visit", "_t", order)
    counted = dealt.mapInArrow(_admitted([*keys, "_visit"], cap, span, [f.name for f in out.fields]), out)
    return counted.unionByName(events.where(~sound).withColumns({"before": F.lit(0).cast("long"), "refused": F.lit(cap <= 0)}))


def admin_remains(members: DataFrame, changes: DataFrame, company: str = "company_id", user: str = "user_id") -> DataFrame:
    """company, remains: whether an active admin is left after the changes (company, user, role or null, active or null)."""
    c = changes.select(F.col(company).alias("_c"), F.col(user).alias("_u"), F.col("role").alias("_role"), F.col("active").alias("_active"))
    after = members.join(c, (F.col(company) == F.col("_c")) & (F.col(user) == F.col("_u")), "left")
    admin = (F.coalesce("_role", "role") == "admin") & F.coalesce("_active", "active")
    return after.groupBy(company).agg(F.bool_or(admin).alias("remains"))


def permitted(role: Column, action: Column) -> Column:
    """Role and action; unknown roles are denied."""
    return reduce(lambda c, kv: F.when((role == kv[0]) & action.isin(*kv[1]), True).otherwise(c), PERMISSIONS.items(), F.lit(False))


def run_log(documents: DataFrame, attachments: DataFrame, segments: DataFrame, key: str = "run_id") -> DataFrame:
    """key, documents by status, failed attachments (with a list of them), OCR segments, tokens and latency of each run."""
    docs = documents.groupBy(key).agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.round(F.coalesce("latency_ms", F.lit(0.0)))).cast("long").alias("latency_ms"),
    )
    failed = attachments.where("error is not null").groupBy(key).agg(F.count("*").alias("failed_attachments"), F.sort_array(F.collect_list(F.struct("document_id", "name", "error"))).alias("failures"))
    ocr = segments.groupBy(key).agg(F.count_if(F.coalesce("ocr", F.lit(False))).alias("ocr_segments"))
    return docs.join(failed, key, "left").join(ocr, key, "left").na.fill(0, ["failed_attachments", "ocr_segments"])


def present_positions(headers: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Headers with a value and their 1-based position among these."""
    return headers.where(F.coalesce(value, F.lit("")) != "").withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def pages_for_ocr(pages: DataFrame, segments: DataFrame, allowance: int, key: str = "document_id") -> DataFrame:
    """The first ``allowance`` pages of a document without any segment, as runs of consecutive pages: first, last."""
    bare = pages.select(key, "page").distinct().join(segments.select(key, "page").distinct(), [key, "page"], "left_anti")
    order = Window.partitionBy(key).orderBy("page")
    taken = bare.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= allowance)
    return taken.groupBy(key, (F.col("page") - F.col("_n")).alias("_run")).agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("_run")
