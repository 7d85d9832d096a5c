"""Jobs from the state table: what is due, how a failure is classified, retries, and constraints on the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteproof.functions.dealing import parts_for

# Queue settings (seconds), the expiry of a job and its margin, statuses that end one document only.
QUEUES = {
    "process": {"retry_limit": 5, "retry_delay": 30, "retry_delay_max": 1800}, "export": {"retry_limit": 8, "retry_delay": 30, "retry_delay_max": 1800},
    "dead": {"retry_limit": 10, "retry_delay": 60, "retry_delay_max": None},
}
EXPIRE_SECONDS, MARGIN_SECONDS = 3600, 300
DOCUMENT_STATUS = (413, 415, 422)
RETRYABLE = (408, 429, 500, 502, 503, 504)


def due_jobs(requests: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """id, queue: one job for each request that waits and has none queued or active; retries once their time has come."""
    queue = F.when(F.col("status") == "NEW", "process").when(F.col("status") == "APPROVED", "export")
    waiting = requests.withColumn("queue", queue).where(F.col("queue").isNotNull() & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    return waiting.select("id", "queue").dropDuplicates(["id"]).join(active.select("id"), "id", "left_anti")


def retry_delay(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Seconds before the next try: doubled each time up to a cap; jitter is left to the caller."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap)))


def failure_class(error: Column, status: Column, attempts: Column, queue: str = "process") -> Column:
    """document (skip that one), permanent, retry, or dead once the queue's retries are used up."""
    limit = QUEUES[queue]["retry_limit"]
    passing = error.isin("timeout", "unreachable", "unavailable", "unexpected") | F.coalesce(status.isin(*RETRYABLE), F.lit(False))
    return (
        F.when(F.coalesce(status.isin(*DOCUMENT_STATUS), F.lit(False)), "document").when(error.isNull() & status.isNull(), None)
        .when(~F.coalesce(passing, F.lit(False)), "permanent").when(attempts > limit, "dead").otherwise("retry")
    )


def after_failures(requests: DataFrame, failures: DataFrame, now: Column, queue: str = "process") -> DataFrame:
    """``requests`` after a round's failures (id, error, status): permanent and dead ones are ERROR; a retry notes its cause
    and time only while the request is still being processed."""
    f = failures.select(F.col("id").alias("_id"), F.col("error").alias("_error"), F.col("status").alias("_http"))
    settings = QUEUES[queue]
    met = requests.join(f, requests["id"] == F.col("_id"), "left")
    tries = F.col("attempts") + F.when(F.col("_id").isNotNull(), 1).otherwise(0)
    kind = F.when(F.col("_id").isNotNull(), failure_class(F.col("_error"), F.col("_http"), tries, queue))
    met = met.withColumn("_tries", tries).withColumn("_kind", kind).withColumn("_open", F.col("status").isin("NEW", "PROCESSING"))
    ends, again = F.col("_open") & F.col("_kind").isin("permanent", "dead"), F.col("_open") & (F.col("_kind") == "retry")
    wait = retry_delay(F.col("_tries"), settings["retry_delay"], settings["retry_delay_max"] or 2.0**31)
    moved = {
        "status": F.when(ends, "ERROR").otherwise(F.col("status")), "attempts": F.when(F.col("_open"), F.col("_tries")).otherwise(F.col("attempts")),
        "error_stage": F.when(ends, "processing").otherwise(F.col("error_stage")), "error_message": F.when(ends | again, F.coalesce("_error", "error_message")).otherwise(F.col("error_message")),
        "next_retry_at": F.when(ends, F.lit(None).cast("timestamp")).when(again, F.timestamp_seconds(F.unix_timestamp(now) + wait)).otherwise(F.col("next_retry_at")),
    }
    return met.select(*(moved.get(c, F.col(c)).alias(c) for c in requests.columns))


def run_outcome(documents: DataFrame, key: str = "request_id") -> DataFrame:
    """key, processed, skipped, error: a run in which no document was processed has a permanent error."""
    done = F.count_if(F.col("error").isNull())
    return documents.groupBy(key).agg(done.alias("processed"), F.count_if(F.col("error").isNotNull()).alias("skipped")).withColumn("error", F.when(F.col("processed") == 0, "no_document_processed"))


def reprocessed(requests: DataFrame, wanted: DataFrame, may_ingest: Column | None = None) -> DataFrame:
    """id, to, refused for requests to be run again: the stage of the error decides; samples are never extracted anew."""
    allowed = F.lit(True) if may_ingest is None else may_ingest
    stage = F.when(F.col("status") == "ERROR", F.col("error_stage"))
    refused = ~F.coalesce(stage.isin("processing", "export"), F.lit(False)) | ((stage == "processing") & ((F.col("source") == "sample") | ~allowed))
    to = F.when(~refused, F.when(stage == "export", "APPROVED").otherwise("NEW"))
    return wanted.select("id").join(requests, "id", "left").select("id", to.alias("to"), refused.alias("refused"))


def assert_budget(timeout_seconds: float, files: int) -> None:
    """A job must end before it expires, or it would run twice."""
    if timeout_seconds * files + MARGIN_SECONDS >= EXPIRE_SECONDS:
        raise ValueError("the timeout of all files exceeds the expiry of a job")


# --- constraints: each gives the rows that break it


def not_in_set(rows: DataFrame, column: str, allowed) -> DataFrame:
    return rows.where(~F.col(column).isin(*allowed))


def implied(rows: DataFrame, condition: Column, consequence: Column) -> DataFrame:
    """Rows for which the condition holds and the consequence does not (null counts as not)."""
    return rows.where(F.coalesce(condition, F.lit(False)) & ~F.coalesce(consequence, F.lit(False)))


def succeeded_without_reference(exports: DataFrame) -> DataFrame:
    return implied(exports, F.col("status") == "succeeded", F.col("erp_reference").isNotNull() & F.col("exported_at").isNotNull())


def strange_idempotency_key(exports: DataFrame) -> DataFrame:
    return exports.where(~F.col("idempotency_key").eqNullSafe(F.col("request_id")))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; nulls are equal to each other."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows without a parent; a row with a null in its key is not checked."""
    p = parent.select(*(F.col(v).alias(f"_p{k}") for k, v in enumerate(keys.values()))).distinct()
    on = [F.col(c) == F.col(f"_p{k}") for k, c in enumerate(keys)]
    known = child.dropna(subset=list(keys))
    return known.join(p, on, "left_anti")


def lost_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an append-only table that a later snapshot lacks."""
    return old.exceptAll(new)


def without_tenant(tables: dict[str, DataFrame], column: str = "company_id") -> list[str]:
    """Names of tables that carry no tenant column."""
    return sorted(name for name, table in tables.items() if column not in table.columns)


def catalogue(tables: dict[str, DataFrame], column: str = "company_id") -> list[tuple[str, int, bool]]:
    """(name, columns, has a tenant column) of every table, by name."""
    return [(name, len(table.columns), column in table.columns) for name, table in sorted(tables.items())]


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, nullable of every column, from the tables' schemas."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(name, f.name, f.nullable) for name, table in sorted(tables.items()) for f in table.schema.fields], "table string, column string, nullable boolean")


def table_policies(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, columns, tenant_column, has_tenant, n_rows, n_without: a table is protected if it has its tenant column and no row lacks
    a tenant, since a read within a tenant never shows such a row; a table without the column has no row that a tenant may see."""
    columns = columns_of({name: table for name, (table, _) in tables.items()})
    rows = reduce(DataFrame.union, (
        table.agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull() if column in table.columns else F.lit(True)).alias("n_without")).select(F.lit(name).alias("table"), F.lit(column).alias("tenant_column"), "n_rows", "n_without")
        for name, (table, column) in tables.items()
    ))
    counts = columns.groupBy("table").agg(F.count("*").alias("columns"))
    held = columns.select(F.col("table"), F.col("column").alias("tenant_column"), F.lit(True).alias("_has"))
    met = rows.join(counts, "table").join(held, ["table", "tenant_column"], "left")
    return met.select("table", "columns", "tenant_column", F.coalesce("_has", F.lit(False)).alias("has_tenant"), "n_rows", "n_without")


def rejected_answers(answers: DataFrame, fields: DataFrame, segments: DataFrame) -> DataFrame:
    """document_id, reason of answers that are refused whole: another document's id, a segment id twice, found without
    evidence, evidence of a segment that was not returned."""
    other = answers.where(~F.col("answered_id").eqNullSafe(F.col("document_id"))).select("document_id", F.lit("document_id").alias("reason"))
    bare = implied(fields, F.col("status") == "found", F.col("segment_id").isNotNull() & F.col("quote").isNotNull()).select("document_id", F.lit("found_without_evidence"))
    return other.union(bare).union(segment_faults(fields, segments)).distinct()


def segment_faults(fields: DataFrame, segments: DataFrame) -> DataFrame:
    """document_id, reason of segment ids returned twice (nulls are equal to each other) and of evidence of a segment that was not
    returned: both tables meet in one grouping, whose tasks hold a bounded number of segments."""
    key = "document_id", "segment_id"
    cited = fields.select(*key, F.lit(0).alias("_n")).where("segment_id is not null")
    met = cited.union(segments.select(*key, F.lit(1).alias("_n")))
    groups = met.repartition(parts_for(fields, segments), *key).groupBy(*key).agg(F.sum("_n").alias("_returned"), F.min("_n").alias("_least"))
    strange = (F.col("_least") == 0) & (F.col("_returned") == 0) & F.col("document_id").isNotNull()
    reason = F.when(F.col("_returned") > 1, "segment_twice").when(strange, "unknown_segment")
    return groups.select("document_id", reason.alias("reason")).where("reason is not null")
