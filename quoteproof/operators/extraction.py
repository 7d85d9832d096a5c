"""The extraction run of each document as a whole: what the model is asked, what comes of its claims, and the warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteproof.operators import grounding
from quoteproof.schema import HEADER_KEYS

# The warnings, in their order.
WARNINGS = ("no_text", "attachment_failed", "ocr_pages_skipped")


def runs(documents: DataFrame, segments: DataFrame, reports: DataFrame, skipped: DataFrame) -> DataFrame:
    """document_id, n_segments, model_called, warnings: a document without segments has nothing to cite, so no model is asked.

    ``reports``: document_id, status of its attachments; ``skipped``: document_id, pages left without text recognition.
    """
    n = segments.groupBy("document_id").agg(F.count("*").alias("n_segments"))
    failed = reports.where("status = 'failed'").select("document_id", F.lit(True).alias("_failed")).distinct()
    left = skipped.groupBy("document_id").agg(F.sum("pages").alias("_pages"))
    met = documents.select("document_id").join(n, "document_id", "left").join(failed, "document_id", "left").join(left, "document_id", "left")
    holds = (F.col("n_segments").isNull(), F.coalesce("_failed", F.lit(False)), F.coalesce("_pages", F.lit(0)) > 0)
    told = F.array_compact(F.array(*(F.when(h, F.lit(w)) for h, w in zip(holds, WARNINGS, strict=True))))
    return met.select("document_id", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.col("n_segments").isNotNull().alias("model_called"), told.alias("warnings"))


def asked(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Documents for which a model is asked."""
    return documents.join(segments.select("document_id").distinct(), "document_id", "left_semi")


def fields(documents: DataFrame, segments: DataFrame, claims: DataFrame) -> DataFrame:
    """Verified fields as ``grounding.verify`` gives them: every header field of every document, and the items' fields of those
    for which a model was asked. A header field that nothing is claimed of, as all of a document without segments, is missing."""
    header = documents.select("document_id", F.explode(F.array(*map(F.lit, HEADER_KEYS))).alias("field_key"))
    answered = asked(claims, segments)
    own = answered.where("item_index is null").drop("item_index")
    whole = header.join(own, ["document_id", "field_key"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    every = whole.withColumn("item_index", F.lit(None).cast("int")).unionByName(answered.where("item_index is not null"))
    return grounding.verify(every.select(*claims.columns), segments)
