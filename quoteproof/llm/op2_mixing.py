"""Mixing sources to target weights, as a time-varying curriculum.

Training time runs from 0 to 1. Each source has a linear weight schedule; its integral is the source's cumulative
token demand, scaled so that it ends at the source's target. A source's documents stand in a fixed pseudo-random
order (MD5 of doc_id) and fill that demand one after the other, the list twice if need be; inverting the demand at
the middle of what a pass takes of a document gives its training position in that pass, and the mix is range-sorted by
position, a row for each pass. The query has a row for each document, with the positions of its two passes.

Targets: weight shares of a budget, a source capped at ``most_repeats`` times its size, the excess shared out again
by weight until none is above its cap (solved in one pass over the sources ordered by cap/weight).

Null texts have size 0; a null source is a source of its own, ordered last; documents of size 0 are taken 0 times;
repeated rows are rows of their own, ordered by (hash, doc_id, text hash); rows without doc_id are ordered by their text;
empty tables give empty results. Other columns pass through; where one has the name of an added column, the added one's
name gets an underscore at its end. At most one document a source is taken in part, which makes taken words equal the
rounded target. Windows that run over sources alone see one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import SPACE, free_names, load, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST_REPEATS = 2
#: Weight at training time 0 and 1, by the source's place in WEIGHTS; the mean of each is 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: A source's documents are summed by ranges of their hashes first, so that no task sees a source whole: as many hexadecimal
#: digits, within bounds, as leave about so many documents in a range even if one source has all of them.
RANGE_DOCS, RANGES_HEX = 20_000, (3, 6)


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE}]+")).cast("long")


def _by_place(values, place: Column) -> Column:
    out = F.lit(float(values[-1]))
    for k, v in enumerate(values[:-1]):
        out = F.when(place == k, F.lit(float(v))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, budget: float = BUDGET, weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size) one row a source with place, target; the windows run over sources, not documents."""
    ranked = sizes.withColumn("place", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    w = ranked.withColumn("w", _by_place(weights, F.col("place"))).withColumn("cap", most_repeats * F.col("source_size").cast("double"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        w.withColumn("_all", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("_capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.sum("w").over(rest))
        .withColumn("_open", F.when(F.col("_level") * F.col("w") <= F.col("cap"), F.col("_level")))
        .withColumn("_level", F.max("_open").over(everything))
    )
    target = F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("_level") * F.col("w")))
    return level.select("source", "source_size", "place", target.alias("target"))


def _inverse(share: Column, start: Column, end: Column) -> Column:
    """The time at which a linear schedule of mean 1 has given out ``share`` of its tokens."""
    slope = end - start
    root = F.sqrt(F.greatest(start * start + 2 * slope * share, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise((root - start) / F.when(slope == 0, F.lit(1.0)).otherwise(slope))


#: What ``mix`` adds, in this order.
ADDED = ("size", "source_size", "target", "taken", "position", "passes")


def range_digits(n_docs: int) -> int:
    least, most = RANGES_HEX
    return next((k for k in range(least, most) if n_docs <= RANGE_DOCS * 16**k), most)


def _mixed(docs: DataFrame, budget: float, weights, most_repeats: int, schedules, keep: list[str] | None = None) -> DataFrame:
    """_row (all columns of ``docs``, or those to ``keep``) with the columns ``ADDED``."""
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.xxhash64(text_or_empty()).cast("string")))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count().alias("size"),
        F.md5(known.cast("binary")).alias("_hash"), F.xxhash64(text_or_empty()).alias("_tie"),
    ).withColumn("_range", F.substring("_hash", 1, range_digits(docs.count())))
    # a key without nulls, so that the window below leaves rows where the join wants them
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("n")))
    sums = rows.groupBy("_source", "_key", "_range").agg(F.sum("size").alias("_sum"))
    by_range = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(by_range), F.lit(0)))
    targets = source_targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")), budget, weights, most_repeats)
    of_source = F.col("_source").eqNullSafe(F.col("source"))
    starts = starts.join(targets, of_source).select("_key", "_range", "_before", "source_size", "place", "target")
    here = Window.partitionBy("_key", "_range").orderBy("_hash", "_id", "_tie")
    rows = rows.withColumn("_at", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    rows = rows.join(starts, ["_key", "_range"])
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    at, none = F.col("_before") + F.col("_at"), F.lit(0).cast("long")
    start, end = (_by_place([s[k] for s in schedules], F.col("place")) for k in (0, 1))

    def of_pass(k: int) -> Column:
        return F.greatest(none, F.least(F.col("size"), wanted - k * F.col("source_size") - at))

    def at_pass(k: int) -> Column:
        share = F.least((at + k * F.col("source_size") + of_pass(k) / 2.0) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
        return F.struct(F.lit(k).alias("pass"), of_pass(k).alias("taken"), _inverse(share, start, end).alias("position"))

    taken = of_pass(0)
    for k in range(1, most_repeats):
        taken = taken + of_pass(k)
    passes = F.filter(F.array(*(at_pass(k) for k in range(most_repeats))), lambda p: p["taken"] > 0)
    out = rows.withColumn("taken", taken).withColumn("passes", passes).withColumn("position", F.get("passes", F.lit(0))["position"])
    return out.select("_row", *ADDED)


def mix(docs: DataFrame, budget: float = BUDGET, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """``docs`` with size, source_size, target, taken, position (of the first pass; null where nothing is taken) and
    passes, an array of (pass, taken, position) for each pass that takes some of the document."""
    names = free_names(docs.columns, list(ADDED))
    return _mixed(docs, budget, weights, most_repeats, schedules).select("_row.*", *(F.col(c).alias(n) for c, n in zip(ADDED, names, strict=True)))


def _sorted(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position. Positions are shares of training time and each source fills its time evenly by its schedule, so
    ranges of equal width hold about equal work, and no sampling runs the plan twice. What has no position comes last,
    spread by its id."""
    order = [F.col("position").asc_nulls_last(), F.col("_row.doc_id")]
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.least(F.floor(F.col("position") * n), F.lit(n - 1))
    return mixed.repartitionById(2 * n, F.coalesce(own, n + F.pmod(F.xxhash64("_row.doc_id"), F.lit(n))).cast("int")).sortWithinPartitions(*order)


def curriculum(docs: DataFrame, budget: float = BUDGET, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The mix range-sorted by training position: a row for each pass, with what that pass takes; documents that are not
    taken stand once at the end, with null pass and position."""
    mixed = _mixed(docs, budget, weights, most_repeats, schedules).withColumn("_p", F.explode_outer("passes"))
    mixed = mixed.withColumn("pass", F.col("_p.pass")).withColumn("taken", F.coalesce(F.col("_p.taken"), F.lit(0).cast("long"))).withColumn("position", F.col("_p.position"))
    added = ["size", "source_size", "target", "pass", "taken", "position"]
    return _sorted(mixed).select("_row.*", *(F.col(c).alias(n) for c, n in zip(added, free_names(docs.columns, added), strict=True)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, one row for each time one is taken (rounded to whole documents), as ``docs`` has them and
    range-sorted by training position, repeats at their own."""
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    times = F.when(F.col("taken") == 0, 0).otherwise(F.greatest(whole, F.lit(0)))
    copies = _mixed(docs, BUDGET, WEIGHTS, MOST_REPEATS, SCHEDULES).withColumn("_p", F.explode(F.slice("passes", F.lit(1), times)))
    return _sorted(copies.withColumn("position", F.col("_p.position"))).select("_row.*")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = _mixed(docs, BUDGET, WEIGHTS, MOST_REPEATS, SCHEDULES, ["doc_id"])
    again = F.get("passes", F.lit(1))["position"].alias("second_position")
    return _sorted(mixed).select("_row.doc_id", "size", "source_size", "target", "taken", "position", again)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE place WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, place, least(cap, max(CASE WHEN level * w <= cap THEN level END) OVER () * w) AS target FROM l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place, CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(0, least(size, wanted - pos)) AS one, greatest(0, least(size, wanted - source_size - pos)) AS two FROM o
), q AS (
  SELECT *, least((pos + one / CAST(2 AS DOUBLE)) / greatest(target, 1), 1) AS share, least((pos + source_size + two / CAST(2 AS DOUBLE)) / greatest(target, 1), 1) AS share2,
    CASE place WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a, CASE place WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS b FROM p
)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one + two > 0 THEN CASE WHEN a = b THEN share ELSE (sqrt(greatest(a * a + 2 * (b - a) * share, 0)) - a) / (b - a) END END AS position,
  CASE WHEN two > 0 THEN CASE WHEN a = b THEN share2 ELSE (sqrt(greatest(a * a + 2 * (b - a) * share2, 0)) - a) / (b - a) END END AS second_position
FROM q
"""
