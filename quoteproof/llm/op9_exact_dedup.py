"""Exact deduplication by Grace hashing.

Each scan task first folds the copies it meets itself (an open-addressing table of bounded size, which compares
whole contents), so a group of copies sends one record for each task however large it is. The records are dealt by
hash; each receiving task folds its share into such a table, and where the distinct contents outgrow it splits them
into spill files, by further bits of their SHA-256, again and again until each file's contents fit. Small class rows
then meet the rows' (id, SHA-256) pairs in a plain equi-join, whose large partitions Spark may split. Spill files lie
in the task's own folder: a lost task is run anew and makes them anew.

Contents are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty, so null, empty and
blank texts form one class. Of a class the row with the most code points stays, then the smallest doc_id (null
last); of repeated rows with one doc_id a single one is kept. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._encode import blocks
from ._shared import SPACE, SPACE_BYTES, frugal, load, text_or_empty

#: Bytes of content that a table holds at once, before it is sent on or its bucket is split.
TABLE_BYTES = 16_000_000
#: Buckets that a spill makes of one file.
FAN_OUT = 16
#: Four bits of the SHA-256 tell a bucket; contents that agree in all of them are compared in one table.
MOST_DEPTH = 64

RECORD = "h long, sha binary, content binary, n long, best_chars long, best_id long"
CLASS = "sha binary, keep_id long, group_size long"


class ContentTable:
    """Open addressing with linear probing; a slot is equal only if the complete contents are."""

    def __init__(self, slots: int = 1024):
        self.slots: list[list | None] = [None] * slots
        self.used = self.bytes = 0

    def add(self, h: int, sha: bytes, content: bytes, n: int, chars: int, doc) -> None:
        if self.used * 3 >= len(self.slots) * 2:
            old, self.slots = self.slots, [None] * (2 * len(self.slots))
            for row in old:
                if row is not None:
                    self.slots[self._seek(row[0], row[2])] = row
        at = self._seek(h, content)
        row = self.slots[at]
        if row is None:
            self.slots[at] = [h, sha, content, n, chars, doc]
            self.used += 1
            self.bytes += len(content) + 200
            return
        row[3] += n
        if chars > row[4] or chars == row[4] and doc is not None and (row[5] is None or doc < row[5]):
            row[4], row[5] = chars, doc

    def _seek(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (row := self.slots[at]) is not None and not (row[0] == h and row[2] == content):
            at = (at + 1) & mask
        return at

    def rows(self) -> list[list]:
        return [r for r in self.slots if r is not None]


def _records(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["h", "sha", "content", "n", "best_chars", "best_id"]
    )


def _fold(batches):
    """Scan side: the copies within a task become one record."""
    table = ContentTable()
    for batch in batches:
        texts, ids = batch.column("_text").to_pylist(), batch.column("_id").to_pylist()
        for text, doc in zip(texts, ids, strict=True):
            content = text.encode().translate(None, SPACE_BYTES)
            sha = hashlib.sha256(content).digest()
            table.add(int.from_bytes(sha[:8], "little", signed=True), sha, content, 1, len(text), doc)
            if table.bytes > TABLE_BYTES:
                yield from _sent(table)
                table = ContentTable()
    yield from _sent(table)


def _sent(table: ContentTable):
    rows = table.rows()
    for start, end in blocks([r[2] for r in rows]):
        yield _records(rows[start:end])


def _bucket(sha: bytes, depth: int) -> int:
    """Other bits at each depth, and other ones than those by which rows are dealt out."""
    byte = sha[31 - depth // 2]
    return byte >> 4 if depth % 2 else byte & 15


def _grace(rows, folder: str, depth: int, table_bytes: int):
    """Classes of the rows: in one table if their distinct contents fit, else bucket by bucket from spill files."""
    rows, table = iter(rows), ContentTable()
    for row in rows:
        table.add(*row)
        if table.bytes > table_bytes and table.used > 1 and depth < MOST_DEPTH:
            break
    else:
        yield from table.rows()
        return
    names = [os.path.join(folder, f"{depth}-{k}-{os.urandom(4).hex()}") for k in range(FAN_OUT)]
    files, filled = [open(n, "wb") for n in names], set()  # noqa: SIM115
    try:
        for row in chain(table.rows(), rows):
            table = None  # its rows are all that is still held
            k = _bucket(row[1], depth)
            pickle.dump(tuple(row), files[k], protocol=5)
            filled.add(k)
    finally:
        for f in files:
            f.close()
    for k, name in enumerate(names):
        if k in filled:
            yield from _grace(_spilled(name), folder, depth + 1, table_bytes)
        os.unlink(name)


def _spilled(name: str):
    with open(name, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _classes(table_bytes: int):
    def run(batches):
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:  # this task's own; a lost task is run anew
            source = (row for batch in batches for row in _rows(batch))
            out: list[list] = []
            for row in _grace(source, folder, 0, table_bytes):
                out.append(row)
                if len(out) == 10_000:
                    yield _class_batch(out)
                    out = []
            yield _class_batch(out)

    return run


def _rows(batch):
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _class_batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[1] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
        names=["sha", "keep_id", "group_size"],
    )


def normal_sha(text: str = "text"):
    """SHA-256 of the text without white space, as the tables compute it, by the JVM."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), f"[{SPACE}]+", "").cast("binary"), 256))


def classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """sha, keep_id, group_size: one row for each distinct content."""
    folded = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_text")).mapInArrow(frugal(_fold), RECORD)
    return folded.repartition("h").mapInArrow(frugal(_classes(table_bytes)), CLASS)


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All rows of ``docs`` as doc_id, keep_id, group_size, kept, text_sha256."""
    found = classes(docs, table_bytes)
    rows = docs.select("doc_id", F.char_length(text_or_empty()).alias("_chars"), normal_sha().alias("sha"))
    # repeated rows of one doc_id: the longest of them stands for it
    one = Window.partitionBy("sha", "doc_id").orderBy(F.col("_chars").desc())
    return (
        rows.withColumn("_nth", F.row_number().over(one))
        .join(found, "sha")
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose content another row keeps; whatever their other columns are called."""
    found = classes(docs).select(F.col("sha").alias("_class"), F.col("keep_id").alias("_keep"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_id"), F.char_length(text_or_empty()).alias("_chars"), normal_sha().alias("_sha"))
    one = Window.partitionBy("_sha", "_id").orderBy(F.col("_chars").desc())
    met = rows.join(found, (F.col("_sha") == F.col("_class")) & F.col("_id").eqNullSafe(F.col("_keep")))
    return met.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("_row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, arg_min(doc_id, (-length(t), doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
