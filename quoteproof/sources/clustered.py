"""Lists read page by page from files that lie in the order of the list.

The writer range-sorts rows by (tenant, time descending with nulls first, id descending) and keeps an index with one row for each
tenant and file: how many rows, the newest and the oldest. A page needs only the first files behind its cursor that hold
enough rows, which the index tells, so it reads a bounded number of files whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteproof.schema import PAGE


class ClusteredList:
    """``tenant``, ``at`` and ``key`` name the columns of the order; ``key`` is unique within a tenant and time."""

    def __init__(self, spark: SparkSession, folder: str, tenant: str, at: str, key: str):
        self.spark, self.folder, self.tenant, self.at, self.key = spark, folder.rstrip("/"), tenant, at, key

    def _place(self) -> Column:
        """Greater is nearer to the top of the list."""
        return F.struct(F.col(self.at).isNull().alias("bare"), F.col(self.at).alias("at"), F.col(self.key).alias("key"))

    def write(self, rows: DataFrame, files: int) -> None:
        order = [F.col(self.tenant), F.col(self.at).desc_nulls_first(), F.col(self.key).desc()]
        rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{self.folder}/rows")
        written = self.spark.read.parquet(f"{self.folder}/rows")
        by_file = written.groupBy(F.col(self.tenant).alias("tenant"), F.col("_metadata.file_path").alias("file"))
        index = by_file.agg(F.count("*").alias("rows"), F.max(self._place()).alias("newest"), F.min(self._place()).alias("oldest"))
        index.repartitionByRange("tenant").sortWithinPartitions("tenant", "newest").write.parquet(f"{self.folder}/index")

    def _behind(self, cursor: tuple) -> Column:
        at, key = cursor
        later = F.col(self.key) < F.lit(key)
        if at is None:
            return F.col(self.at).isNotNull() | (F.col(self.at).isNull() & later)
        return (F.col(self.at) < F.lit(at)) | ((F.col(self.at) == F.lit(at)) & later)

    def files(self, tenant, cursor: tuple | None = None, size: int = PAGE) -> list[str]:
        """The files that hold the ``size`` + 1 rows behind the cursor."""
        own = self.spark.read.parquet(f"{self.folder}/index").where(F.col("tenant") == F.lit(tenant))
        if cursor is not None:
            above = F.struct(F.lit(cursor[0] is None).alias("bare"), F.lit(cursor[0]).cast(own.schema["newest"].dataType["at"].dataType).alias("at"), F.lit(cursor[1]).cast(own.schema["newest"].dataType["key"].dataType).alias("key"))
            own = own.where(F.col("oldest") < above).withColumn("rows", F.when(F.col("newest") < above, F.col("rows")).otherwise(0))
        out, held = [], 0
        for r in own.orderBy(F.col("newest").desc()).limit(size + 2).collect():  # a file has a row at least, the first may have some before the cursor
            out.append(r["file"])
            held += r["rows"]
            if held > size:
                break
        return out

    def page(self, tenant, cursor: tuple | None = None, size: int = PAGE) -> DataFrame:
        """``size`` rows and one more that tells of a next page, newest first; ``cursor``: (at, key) of the last row seen."""
        table = self.spark.read.parquet(f"{self.folder}/rows")
        paths = self.files(tenant, cursor, size)
        if not paths:
            return table.limit(0)
        rows = self.spark.read.schema(table.schema).parquet(*paths).where(F.col(self.tenant) == F.lit(tenant))
        rows = rows if cursor is None else rows.where(self._behind(cursor))
        return rows.orderBy(F.col(self.at).desc_nulls_first(), F.col(self.key).desc()).limit(size + 1)
