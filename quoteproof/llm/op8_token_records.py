"""Token ids in length-delimited binary records with an offset index.

A record frames one document::

    length  u64 little-endian   bytes of the payload
    check   u32                 masked CRC-32 of the 8 length bytes
    payload                     u8 (1, or 0 for a null doc_id), doc_id i64, then the ids as u16 or u32
    check   u32                 masked CRC-32 of the payload
    end     0x0A                (put by the writer)

Documents are range-partitioned by doc_id, so the data files in the order of their shard numbers (the number in the
name, as a number) hold ascending ids. Spark's own writer and commit protocol put the frames on any file system (lost
and repeated tasks leave no half files); the index, a separate table, gives file, shard, ordinal, offset, length,
n_tokens and the start within all ids of each record, so records can be read in any order. Readers verify both
checksums and fail on a damaged record.

Null texts are empty (their record holds the end id only); repeated rows become records of their own, ordered by
(doc_id, hash of the text), equal ones by the partition they come from, so that they may fill several files; a null
doc_id comes first; any i64 is a doc_id; other columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._encode import encoder, text_blocks, tokenizer_path
from ._shared import frugal, load, scratch, text_or_empty

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Bytes of text that make one data file; a file is read as a whole by one task.
SHARD_TEXT_BYTES = 16_000_000
#: Most ranges that documents are dealt to; of a larger corpus a range is written as several files.
MOST_RANGES = 100_000
#: Bytes of a payload before the ids.
HEAD = 9

INDEX = "file string, shard long, ordinal long, doc_id long, offset long, length long, n_tokens long, in_file long"
RECORD = "file string, offset long, doc_id long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """A checksum that does not look like one of the data it may itself be part of: rotated and shifted by a constant."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    payload = struct.pack("<Bq", doc_id is not None, doc_id or 0) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(content: memoryview, offset: int) -> tuple[int | None, memoryview, int]:
    """doc_id, ids and the next offset; raises ValueError on damage."""
    head = bytes(content[offset : offset + 8])
    if len(head) < 8 or struct.unpack_from("<I", content, offset + 8)[0] != masked(head):
        raise ValueError(f"damaged length at offset {offset}")
    n = struct.unpack("<Q", head)[0]
    start = offset + 12
    payload = content[start : start + n]
    if len(payload) < n or struct.unpack_from("<I", content, start + n)[0] != masked(payload):
        raise ValueError(f"damaged record at offset {offset}")
    known, doc = struct.unpack_from("<Bq", payload)
    return doc if known else None, payload[HEAD:], start + n + 5


def shard_of(name: str) -> int:
    """The shard number of a data file: its range and its place among the files of the range."""
    part, nth = re.match(r"part-(\d+)(?:.*-c(\d+)\.txt)?", name).groups()
    return int(part) << 24 | int(nth or 0)


def _width(path: str) -> str:
    return "<u2" if encoder(path).library.get_vocab_size() <= 65536 else "<u4"


def _frames(path: str, end_id: int):
    def run(batches):
        encode, width = encoder(path).encode, _width(path)
        end = np.asarray([end_id], dtype=width).tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in text_blocks(batch.column("_text")):
                rows = [frame(doc, np.frombuffer(raw, "<u4").astype(width).tobytes() + end) for doc, raw in zip(ids[a:b], encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    return run


def write_records(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Data files below ``folder``/data and the index below ``folder``/index."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    size, n_docs = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-size // shard_bytes))
    ranges = min(shards, MOST_RANGES)
    records = -(-n_docs // shards) if shards > ranges else 0  # of a file; 0: all of a range
    order = [F.col("doc_id"), F.xxhash64("_text"), F.col("_from")]
    dealt = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    frames = dealt.drop("_from").mapInArrow(frugal(_frames(path, end_id), "encoders"), "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", records).text(f"{folder}/data")
    files(docs.sparkSession, folder).mapInArrow(_index(path), INDEX).write.parquet(f"{folder}/index")


def files(spark: SparkSession, folder: str) -> DataFrame:
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/data")
    return data.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _scan(batch, width: int):
    """(file, offset, next offset, doc_id, ids) of all records, one file at a time."""
    for k in range(batch.num_rows):
        name = batch.column("file")[k].as_py()
        content = memoryview(batch.column("content")[k].as_buffer())
        at = 0
        while at < len(content):
            doc, ids, after = read_frame(content, at)
            yield name, at, after, doc, ids
            at = after


def _index(path: str):
    def run(batches):
        width = np.dtype(_width(path)).itemsize
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            last, nth, tokens = None, 0, 0
            for name, at, after, doc, ids in _scan(batch, width):
                if name != last:
                    last, nth, tokens = name, 0, 0
                n = len(ids) // width
                for col, v in zip(cols, (name, shard_of(name), nth, doc, at, after - at, n, tokens), strict=True):
                    col.append(v)
                nth, tokens = nth + 1, tokens + n
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[x.split()[0] for x in INDEX.split(", ")])

    return run


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: the ids of all records before, in the order of the shards."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    totals = index.groupBy("file", "shard").agg(F.sum("n_tokens").alias("_n")).withColumn("_range", F.shiftright("shard", 24))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # over the ranges, of which there are at most MOST_RANGES, and over the files of one range
    ranges = totals.groupBy("_range").agg(F.sum("_n").alias("_n")).select("_range", earlier(Window.orderBy("_range")).alias("_start"))
    own = totals.withColumn("_within", earlier(Window.partitionBy("_range").orderBy("shard", "file")))
    bases = own.join(ranges, "_range").select("file", (F.col("_start") + F.col("_within")).alias("_base"))
    return index.join(bases, "file").withColumn("start", F.col("_base") + F.col("in_file")).drop("_base", "in_file")


def read_records(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """All records, verified: file, offset, doc_id, n_tokens, ids_crc32 (over the ids as u32)."""

    def run(batches):
        dtype = np.dtype(_width(path))
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for name, at, _, doc, ids in _scan(batch, dtype.itemsize):
                wide = np.frombuffer(ids, dtype).astype("<u4")
                for col, v in zip(cols, (name, at, doc, len(wide), zlib.crc32(wide.tobytes())), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[x.split()[0] for x in RECORD.split(", ")])

    return files(spark, folder).mapInArrow(run, RECORD)


def read_shuffled(spark: SparkSession, folder: str, path: str, seed: int) -> DataFrame:
    """Ids by the index, in an order fixed by ``seed``: place, doc_id, ids (array of int)."""

    def run(batches):
        dtype = np.dtype(_width(path))
        for batch in batches:
            out: list[list] = [[], [], []]
            for content, wanted in zip(batch.column("content"), batch.column("wanted").to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                for w in wanted:
                    doc, ids, _ = read_frame(view, w["offset"])
                    for col, v in zip(out, (w["place"], doc, np.frombuffer(ids, dtype).astype("int32")), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["place", "doc_id", "ids"])

    place = F.xxhash64(F.lit(seed), "file", "ordinal").alias("place")
    wanted = read_index(spark, folder).groupBy("file").agg(F.sort_array(F.collect_list(F.struct(place, "offset"))).alias("wanted"))  # one file's records
    return files(spark, folder).join(wanted, "file").select("content", "wanted").mapInArrow(run, "place long, doc_id long, ids array<int>").orderBy("place")


def op8_framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, path = scratch(spark, "records"), tokenizer_path(TOKENIZER)
    write_records(load(spark, sf_dir, "documents"), folder, path)
    starts = read_index(spark, folder).select("file", "offset", "start")
    return read_records(spark, folder, path).join(starts, ["file", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")
