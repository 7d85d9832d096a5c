"""Request lists, duplicates, lifecycle folds and ledgers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteproof.functions.runs import run_starts
from quoteproof.schema import PAGE, TRANSITIONS


def keyset_page(rows: DataFrame, at: str, key: str, cursor: tuple | None = None, size: int = PAGE) -> DataFrame:
    """Newest first, ``size`` rows and one more that tells of a next page; the row-value comparison is spelled out, so it is pushed down."""
    if cursor is not None:
        a, k = cursor
        rows = rows.where((F.col(at) < F.lit(a)) | ((F.col(at) == F.lit(a)) & (F.col(key) < F.lit(k))))
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(size + 1)


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the filters that are set; None filters nothing."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if v is not None), rows)


def first_earlier(rows: DataFrame, id_col: str, order: list[str], keys: list[Column]) -> DataFrame:
    """For each row the earliest earlier row that shares one of the keys: a union of key spaces, not a join with OR.

    The earliest row of a key is that of all its rows but itself, so a key needs only its least row, which is found before
    the shuffle; the join that follows may be split where one key holds many rows.
    """
    spaces = [rows.select(F.col(id_col).alias("_id"), F.struct(*order).alias("_o"), F.lit(k).alias("_space"), key.cast("string").alias("_key")) for k, key in enumerate(keys)]
    every = reduce(DataFrame.union, spaces)
    least = every.where("_key is not null").groupBy("_space", "_key").agg(F.min(F.struct("_o", "_id")).alias("_first"))
    met = every.join(least, ["_space", "_key"], "left")
    earlier = F.when((F.col("_first._o") < F.col("_o")) | ((F.col("_first._o") == F.col("_o")) & (F.col("_first._id") < F.col("_id"))), F.col("_first"))
    seen = met.groupBy("_id").agg(F.min(earlier).alias("_first"))
    return seen.select(F.col("_id").alias(id_col), F.col("_first._id").alias("duplicate_of"))


def composed(starts: np.ndarray, codes: np.ndarray, to: np.ndarray, illegal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of events as one function: for every state the state after the run, and the illegal events on the way.

    Neighbours are composed pairwise, so a run of n events takes log n rounds.
    """
    ends, bad = to[codes], illegal[codes]
    run = np.cumsum(starts) - 1
    sizes = np.bincount(run) if len(run) else np.zeros(0, dtype=np.int64)
    while len(sizes) and sizes.max() > 1:
        place = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.flatnonzero(place % 2 == 0)
        paired = np.flatnonzero((place + 1 < sizes[run])[first])
        one = first[paired]
        new_ends, new_bad = ends[first], bad[first]
        new_bad[paired] = bad[one] + np.take_along_axis(bad[one + 1], ends[one], 1)
        new_ends[paired] = np.take_along_axis(ends[one + 1], ends[one], 1)
        ends, bad, run, sizes = new_ends, new_bad, run[first], (sizes + 1) // 2
    return ends, bad


def _composing(key: str, to: np.ndarray, illegal: np.ndarray, names: list[str]):
    """Rows sorted by key and order in, one function for each key of the task out; a key may go on in the next task."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column, part = batch.column(key), batch.column("_part")[0].as_py()
            starts = run_starts([column], None if held is None else (held[0],))
            goes_on = not starts[0]
            places = np.flatnonzero(starts) if not goes_on else np.concatenate([[0], np.flatnonzero(starts)])
            starts[0] = True
            ends, bad = composed(starts, batch.column("_code").to_numpy(), to, illegal)
            if held is not None and goes_on:
                bad[0] = held[2] + bad[0][held[1]]
                ends[0] = ends[0][held[1]]
            done = [] if held is None or goes_on else [held]
            keys = column.take(pa.array(places)).to_pylist()
            done += list(zip(keys, ends, bad, strict=True))
            held = done.pop()
            yield batch_of(done, column.type, part)
        if held is not None:
            yield batch_of([held], column.type, part)

    def batch_of(rows, kind, part):
        keys, ends, bad = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [pa.array(keys, kind), pa.array([part] * len(keys), pa.int32()), pa.array([e.tolist() for e in ends], pa.list_(pa.int32())), pa.array([b.tolist() for b in bad], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return run


def state_table(start: str, table) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(states, events, to, illegal) of a transition table; the row behind the last event is that of any other event."""
    states = sorted({start, *(s for _, a, b in table for s in (a, b))})
    events = sorted({e for e, _, _ in table})
    to = np.tile(np.arange(len(states)), (len(events) + 1, 1))
    illegal = np.ones(to.shape, dtype=np.int64)
    for e, a, b in table:
        at = events.index(e), states.index(a)
        to[at], illegal[at] = states.index(b), 0
    return states, events, to, illegal


def fold(rows: DataFrame, key: str, order: list[str], event: str, start: str, table=TRANSITIONS) -> DataFrame:
    """State of each key after its events in order; an illegal event keeps the state and is counted.

    An event is a function of the state, and functions compose: rows are dealt out in ranges of (key, order), so that a
    key with many events lies in many tasks, each task composes its part of a key into one function, and a key's few
    functions (one a task) are applied in turn. No row holds a key's history.
    """
    states, events, to, illegal = state_table(start, table)
    code = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, e in enumerate(events) for x in (e, k))), F.col(event)), F.lit(len(events)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, *order, code.alias("_code")).repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    schema = rows.select(key).schema.add("_part", T.IntegerType()).add("_to", T.ArrayType(T.IntegerType())).add("_bad", T.ArrayType(T.LongType()))
    functions = dealt.select(key, "_code", F.spark_partition_id().alias("_part")).mapInArrow(_composing(key, to, illegal, schema.names), schema)
    begin = F.struct(F.lit(states.index(start)).alias("s"), F.lit(0).cast("long").alias("n"))
    applied = lambda acc, f: F.struct(F.get(f["_to"], acc["s"]).alias("s"), (acc["n"] + F.get(f["_bad"], acc["s"])).alias("n"))
    each = functions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "_to", "_bad"))).alias("_f"))
    done = each.withColumn("_r", F.aggregate("_f", begin, applied))
    return done.select(key, F.get(F.array(*map(F.lit, states)), F.col("_r.s")).alias("status"), F.col("_r.n").alias("illegal_steps"))


def upsert_ledger(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Insert or increment while pending: rows already succeeded keep their attempts."""
    b = batch.groupBy(key).agg(F.count("*").alias("_more"), F.bool_or("succeeded").alias("_done"))
    joined = old.join(b, key, "full_outer")
    pending = F.coalesce(F.col("status"), F.lit("pending")) == "pending"
    return joined.select(
        key, (F.coalesce("attempts", F.lit(0)) + F.when(pending, F.coalesce("_more", F.lit(0))).otherwise(0)).cast("long").alias("attempts"),
        F.when(pending & F.coalesce("_done", F.lit(False)), "succeeded").otherwise(F.coalesce("status", F.lit("pending"))).alias("status"),
    )


def only_new(batch: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """What a sink has not yet done: safe to run again."""
    return batch.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def islands(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Runs of consecutive numbers by key: first, last, length."""
    one = rows.select(key, n).distinct()
    marked = one.withColumn("_g", F.col(n) - F.row_number().over(Window.partitionBy(key).orderBy(n)))
    return marked.groupBy(key, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("length")).drop("_g")


def violations(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """rule, violations: each rule is the DataFrame of rows that break it."""
    return reduce(DataFrame.union, (df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules))


def set_fingerprint(hashes: str) -> Column:
    """An aggregate: the SHA-256 of a group's distinct hashes, sorted, a line each."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(hashes)), "\n").cast("binary"), 256)
