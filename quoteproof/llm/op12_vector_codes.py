"""Vector compression: product codes whose codebooks are fitted by Yinyang Lloyd, in whole numbers.

Components become floor(1024 x); a vector is cut into equal parts, and each part position has a codebook of at most 256
entries. A round assigns every part to its nearest entry and moves each entry to the floor of its parts' mean. Entries are
clustered into groups once; each part carries its entry and, for each group, one lower bound of the distance to all other
entries of the group. After a round the bounds fall by their group's largest drift, and only groups whose bound does not
exceed the exact distance to the own entry are scanned. Scans compare squared distances as whole numbers (in double
precision where that is provably exact, else in 64-bit integers), so ties go to the lower index and bounds only ever spare
work. The state is one table a round, written by one pass that also gives each task's sums; entries (at most 256 times the
dimension) are all that the driver holds.

Rows whose vector is null or has null, NaN or infinite components are dropped. The dimension is the commonest length of
the others (the longer of equals); rows of another length stay, without code and error, and fit nothing. A length that the
parts do not divide, or components of 2^14 and more, raise an error, as no code or sum would be right. Entries start from the
rows with the smallest ids; equal ids are ordered by their components, null ids come last; with fewer rows than
entries there are fewer entries. Repeated rows are rows of their own; extra columns are not carried; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import discard, frugal, load, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of entries, each with one lower bound a part.
GROUPS = 16
#: Largest component, so that squared distances and sums stay within 64 bits.
MOST = 1 << 26
#: Vectors compared at once.
BLOCK = 4096
#: So many labels are sent to all tasks; of more, only the frequent ones are.
FEW_LABELS = 100_000


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and the vector's whole numbers, without vectors that are null or hold null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < MOST // SCALE, F.floor(v * SCALE).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for whole-number codes"))))
    return table.where(F.col(vector_col).isNotNull()).where(sound).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("vector"))


def entry_groups(entries: np.ndarray) -> np.ndarray:
    """A group for each entry, by a few Lloyd steps; any grouping gives the same codes."""
    centres = entries[:: max(1, -(-len(entries) // GROUPS))].astype(float)
    group = np.zeros(len(entries), dtype=int)
    for _ in range(5):
        group = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(len(centres)):
            if (group == g).any():
                centres[g] = entries[group == g].mean(0)
    return group


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``, as int64."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 8 * top * top * max(1, x.shape[1]) < 1 << 53:  # every partial sum is a whole number that a double holds
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return ((x[:, None, :] - c[None]) ** 2).sum(2)


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, exact squared distance, bounds, rows x groups scanned) of one part position.

    ``bounds[r, g]`` is a lower bound of the distance of row r to the entries of group g other than ``own[r]``.
    """
    own, bounds, scanned = own.copy(), bounds.copy(), 0
    best = ((x - entries[own]) ** 2).sum(1)
    for g in range(bounds.shape[1]):
        members = np.flatnonzero(group == g)
        rows = np.flatnonzero(bounds[:, g] <= np.sqrt(best.astype(float)) * (1 + 1e-12))
        if not len(members) or not len(rows):
            continue
        scanned += len(rows)
        far = np.iinfo(np.int64).max
        d = squared(x[rows], entries[members])
        d[members[None] == own[rows][:, None]] = far
        at = d.argmin(1)  # the lower index of equals
        first = d[np.arange(len(rows)), at]
        d[np.arange(len(rows)), at] = far
        second = d.min(1) if len(members) > 1 else np.full(len(rows), far)
        better = (first < best[rows]) | ((first == best[rows]) & (members[at] < own[rows]))
        bounds[rows, g] = np.sqrt(np.where(better, second, first).astype(float)) * (1 - 1e-12)
        won = rows[better]
        left = group[own[won]]  # what is given up bounds its group from now on
        bounds[won, left] = np.minimum(bounds[won, left], np.sqrt(best[won].astype(float)) * (1 - 1e-12))
        best[won], own[won] = first[better], members[at[better]]
    return own, best, bounds, scanned


def _kept_bounds(bounds: np.ndarray) -> np.ndarray:
    """Bounds rounded down to 16 bits: still bounds."""
    return np.floor(np.clip(bounds, 0, 65535)).astype("<u2")


def _pass(books: np.ndarray, drift: np.ndarray | None, groups: np.ndarray, out: pa.Schema, sums_wanted: bool):
    """One pass over the state: new codes, bounds and errors, and behind them a row with the task's sums."""
    parts, entries, width = books.shape
    n_groups = int(groups.max(initial=-1)) + 1

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                n = part.num_rows
                x = _numbers(part.column("vector"), n, "<i4").reshape(n, parts, width).astype(np.int64)
                if drift is None:
                    own, bounds = np.zeros((n, parts), dtype=np.int64), np.zeros((n, parts, n_groups))
                else:
                    own = _numbers(part.column("code"), n, "u1").reshape(n, parts).astype(np.int64)
                    bounds = _numbers(part.column("bounds"), n, "<u2").reshape(n, parts, n_groups) - drift[None]
                error = np.zeros(n, dtype=np.int64)
                for p in range(parts):
                    own[:, p], best, bounds[:, p], _ = assign(x[:, p], books[p], groups[p], own[:, p], bounds[:, p])
                    error += best
                    if sums_wanted:
                        np.add.at(sums[p], own[:, p], x[:, p])
                        counts[p] += np.bincount(own[:, p], minlength=entries)
                codes = own.astype("u1")
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("vector"), pa.array([r.tobytes() for r in codes], pa.binary()),
                     pa.array([r.tobytes() for r in _kept_bounds(bounds)] if sums_wanted else [None] * n, pa.binary()), pa.array(error, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                    schema=out,
                )
        if sums_wanted:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in out if f.name != "sums"), pa.array([np.concatenate([sums.ravel(), counts.ravel()])], pa.list_(pa.int64()))], schema=out)

    return run


def _numbers(column: pa.Array, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind) if n else np.zeros(0, dtype=kind)


def _packed(state: DataFrame) -> DataFrame:
    """Whole numbers as little-endian bytes, which a pass reads without unpacking lists."""

    def run(batches):
        for batch in batches:
            x = batch.column("vector")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([np.asarray(v, dtype="<i4").tobytes() for v in x.to_pylist()], pa.binary())], names=["vec_id", "label", "vector"]
            )

    return state.mapInArrow(run, T.StructType([state.schema["vec_id"], state.schema["label"], T.StructField("vector", T.BinaryType())]))


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of ``whole_vectors`` and the codebooks (part x entry x position) after ``rounds`` rounds."""
    spark = whole.sparkSession
    lengths = whole.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(2)
    result = T.StructType([whole.schema["vec_id"], whole.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not lengths:
        return spark.createDataFrame([], result), np.zeros((parts, 0, 0), dtype=np.int64)
    dims = lengths[0]["d"]
    if dims % parts:
        raise ValueError(f"{parts} equal parts need a length that they divide, not {dims}")
    same = whole.where(F.size("vector") == dims)
    seeds = [r["vector"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    books = np.asarray(seeds, dtype=np.int64).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2)
    groups = np.stack([entry_groups(b) for b in books])
    schema = T.StructType([*result.fields[:2], *(T.StructField(n, T.BinaryType()) for n in ("vector", "code", "bounds")), T.StructField("error", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    arrow = _arrow(schema)
    table, drift, before = _packed(same), None, None
    for _ in range(rounds):
        state = materialise(table.mapInArrow(frugal(_pass(books, drift, groups, arrow, True)), schema), "codes")
        discard(before)
        totals = np.zeros(books.size + books.shape[0] * books.shape[1], dtype=np.int64)
        for r in state.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # the size of the codebooks
            totals[r["pos"]] = r["n"]
        sums, counts = totals[: books.size].reshape(books.shape), totals[books.size :].reshape(books.shape[:2], order="C")
        moved = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        far = np.sqrt(((moved - books) ** 2).sum(2).astype(float)) * (1 + 1e-12)
        drift = np.stack([np.asarray([far[p][groups[p] == g].max(initial=0.0) for g in range(groups.max(initial=-1) + 1)]) for p in range(parts)])
        books, before, table = moved, state, state.where("sums is null")
    last = table.mapInArrow(frugal(_pass(books, drift, groups, arrow, False)), schema)
    coded = last.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    if len(lengths) > 1:
        others = whole.where(F.size("vector") != dims)
        coded = coded.unionByName(others.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    return coded, books


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: errors summed over rows of equal label, null labels together. ``coded`` is a written table."""
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    rows, labels = sums.agg(F.sum("_n"), F.count("*")).head()
    # each of the frequent labels holds more than one row in FEW_LABELS, so there are fewer than FEW_LABELS of them
    frequent = sums if labels <= FEW_LABELS else sums.where(F.col("_n") > (rows or 0) // FEW_LABELS)
    met = coded.join(F.broadcast(frequent.select(F.col("label").alias("_label"), "label_error", F.lit(True).alias("_met"))), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    if labels <= FEW_LABELS:
        return met.drop("_met")
    rest = met.where("_met is null").drop("label_error", "_met")
    rare = sums.where(F.col("_n") <= (rows or 0) // FEW_LABELS).select(F.col("label").alias("_label"), "label_error")
    return met.where("_met").drop("_met").unionByName(rest.join(rare, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label"))


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(whole_vectors(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    summed = with_label_error(materialise(coded, "coded"))
    return summed.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
