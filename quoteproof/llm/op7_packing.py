"""Best-fit packing by minimum bin slack.

Documents become ids; longer ones are cut into full pieces behind one shorter first piece. Lengths are whole numbers
up to the sequence length, so the pieces still to place are fully described by a histogram with at most that many
entries, whatever the corpus. On it, minimum bin slack runs exactly: the longest length left is set, a subset-sum
dynamic program over bitsets finds the fullest combination of lengths for the rest of the bin, and the combination
is removed as often as the counts allow. Each length's pieces then take the slots of these combinations by their
rank, which is a join of prefix sums; no task ever sees all pieces.

A null text is an empty document (its end id only). Repeated rows and ties are pieces of their own, ordered by
(doc_id, piece, crc). Other columns are not carried. An empty table packs into no sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._encode import encoder, text_blocks, tokenizer_path
from ._shared import frugal, load, materialise, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 2048
END_ID = 0
#: Prefix sums of ranks go over hash ranges of the pieces of one length: about one for so many pieces, within bounds.
RANGE_PIECES, RANGES = 200_000, (256, 1 << 16)

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, most: int, end_id: int):
    def run(batches):
        encode = encoder(path).encode
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in text_blocks(batch.column("_text")):
                cols: list[list] = [[], [], [], [], []]
                for doc, raw in zip(ids[a:b], encode(texts), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = n % most or most
                    for k, stop in enumerate(range(first, n + 1, most)):
                        start = 0 if k == 0 else stop - most
                        for col, v in zip(cols, (doc, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(frugal(_pieces(path, most, end_id), "encoders"), PIECE)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths of the fullest combination within ``room``: bitset subset sums, longest lengths first, and the way back."""
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            take = min(step, left)
            grown = (reach | reach << (take * length)) & mask
            if grown != reach:
                trail.append((length, take, reach))
                reach = grown
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            out += [length] * take
            total -= take * length
    return out


def bin_plan(histogram: dict[int, int], most: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(combination, times) until no piece is left."""
    counts, plan = dict(histogram), []
    while counts:
        longest = max(counts)
        rest = {k: v - (k == longest) for k, v in counts.items() if v > (k == longest)}
        combination = [longest, *fullest(rest, most - longest)]
        need = Counter(combination)
        times = min(counts[k] // v for k, v in need.items())
        plan.append((combination, times))
        for k, v in need.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return plan


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): a run of ranks that takes one slot in consecutive sequences."""
    rank: Counter = Counter()
    base, out = 0, []
    for combination, times in plan:
        offset = 0
        for length in combination:
            out.append((length, rank[length], rank[length] + times - 1, base, offset))
            rank[length] += times
            offset += length
        base += times
    return out


def pack(cut: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut`` is read three times and so should be a written table."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``most`` rows
    table = slots(bin_plan(histogram, most))  # bounded by the lengths, not by the pieces
    schema = "_l long, _from long, _to long, _base long, offset long"
    if table:
        runs = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*table, strict=True)], names=["_l", "_from", "_to", "_base", "offset"]))
    else:
        runs = spark.createDataFrame([], schema)
    ranges = min(max(RANGES[0], sum(histogram.values()) // RANGE_PIECES), RANGES[1])
    ranged = cut.withColumn("_range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)))
    sums = ranged.groupBy("length", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("length").alias("_length"), F.col("_range").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("length", "_range").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        ranged.withColumn("_nth", F.row_number().over(here) - 1)
        .join(starts, (F.col("length") == F.col("_length")) & (F.col("_range") == F.col("_own")))
        .withColumn("_rank", F.col("_before") + F.col("_nth"))
    )
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_l")) & F.col("_rank").between(F.col("_from"), F.col("_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, path: str, most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    return pack(materialise(pieces(docs, path, most, end_id), "pieces"), most)


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
