"""Shared helpers: scratch tables in the cluster's shared folder and small native expressions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a Java/Python character class and as bytes.
SPACE = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all machines share.

    Only where that setting is missing and all runs on one machine (tests, notebooks) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="quoteproof-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, nothing runs twice."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more, to free the shared folder."""
    for table in tables:
        if table is None:
            continue
        jvm, spark = table.sparkSession._jvm, table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Least and most 64-bit masks of ``likely``; the most bound what is broadcast, whatever the corpus.
MASKS = (1 << 10, 1 << 20)


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without those whose key is surely not in ``wanted`` (a written table), by a broadcast bitmap of bounded size.

    It only spares a shuffle; a join must follow. Rows with a null key go.
    """
    slots = min(max(MASKS[0], wanted.count() // 8), MASKS[1])

    def place(frame: DataFrame) -> tuple[Column, Column]:
        h = F.xxhash64(frame[key])
        return F.pmod(h, F.lit(slots)), F.shiftrightunsigned(h, 40).bitwiseAND(63).cast("int")

    slot, bit = place(wanted)
    masks = wanted.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
    slot, bit = place(rows)
    return rows.join(F.broadcast(masks), slot == masks["_slot"]).where(F.getbit("_mask", bit) == 1).select(*rows.columns)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, each with underscores at its end until no column has it (whatever the case of its letters)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: What workers keep from task to task (encoders with their memos), by name.
KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Return freed memory to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def frugal(run, *uses: str):
    """An Arrow iterator function that gives its memory back when a task ends: Python workers are used again, also by other
    stages, and what one has freed stays with it otherwise. What earlier stages left in ``KEPT`` goes when a task begins, but for
    what this one ``uses``."""

    def wrapped(batches):
        from quoteproof.llm._shared import KEPT as kept  # the worker's own, not a copy sent with this function
        from quoteproof.llm._shared import give_back

        for name, held in kept.items():
            if name not in uses:
                held.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
