"""A keyed table in bucketed files, whose content is what its newest manifest names.

Keys are hashed into a fixed number of buckets, so a batch reads and rewrites only the buckets that its keys fall into,
and a bucket is at most ``most_files`` files: the one after that merges them. Writers put data files first, in a folder
of their own, then a manifest with the next number, which only one of them can create: readers see the table before or after a
commit, a writer that died has added nothing, and of two writers at once the second finds its number taken and starts
again from the other's result. A manifest also notes the last batch of each stream, so that a batch that was committed before
its stream's checkpoint was is told from a new one.

The newest manifest holds one entry a file (buckets x most_files at most) and is all that the driver reads. The manifest is
created by a hard link on a local disk and by a rename elsewhere, which must fail where the target exists, as HDFS's does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, MOST_FILES, MOST_TRIES = 64, 8, 20


class Conflict(Exception):
    """Another writer has taken the manifest's number."""


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int = BUCKETS, most_files: int = MOST_FILES):
        self.spark, self.folder, self.schema, self.key, self.buckets, self.most_files = spark, folder.rstrip("/"), schema, key, buckets, most_files
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.local = self.files.getUri().getScheme() == "file"

    # --- manifests

    def _listed(self, folder: str) -> list:
        path = self._path(folder)
        return list(self.files.listStatus(path)) if self.files.exists(path) else []

    def manifest(self) -> dict:
        """The newest manifest; an empty one where nothing is written yet."""
        numbers = [int(s.getPath().getName()[:-5]) for s in self._listed(f"{self.folder}/manifests") if s.getPath().getName().endswith(".json")]
        if not numbers:
            return {"version": 0, "buckets": self.buckets, "files": [], "done": {}}
        text = self.spark.read.text(f"{self.folder}/manifests/{max(numbers):012d}.json", wholetext=True).head()[0]
        return json.loads(text)

    def commit(self, manifest: dict, files: list[list], done: dict[str, int]) -> dict:
        """Make ``files`` the table's content, as the version after ``manifest``; raises ``Conflict`` if that exists."""
        new = {"version": manifest["version"] + 1, "buckets": manifest["buckets"], "files": files, "done": {**manifest["done"], **done}}
        target = self._path(f"{self.folder}/manifests/{new['version']:012d}.json")
        made = self._path(f"{self.folder}/pending/{uuid.uuid4().hex}")
        self.files.mkdirs(target.getParent())
        stream = self.files.create(made, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        if not self._put_if_absent(made, target):
            self.files.delete(made, False)
            raise Conflict(target.toString())
        return new

    def _put_if_absent(self, made, target) -> bool:
        if not self.local:
            return self.files.rename(made, target)
        from py4j.protocol import Py4JJavaError

        paths = self.spark._jvm.java.nio.file.Paths
        try:
            self.spark._jvm.java.nio.file.Files.createLink(paths.get(target.toUri().getPath(), self._none()), paths.get(made.toUri().getPath(), self._none()))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return self.files.delete(made, False)

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)

    # --- rows

    def bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(manifest["buckets"])).cast("int")

    def touched(self, batch: DataFrame, manifest: dict) -> list[int]:
        """Buckets that the batch's keys fall into."""
        return sorted(r[0] for r in batch.select(self.bucket(manifest)).distinct().collect())

    def rows(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some buckets of it, as the manifest (the newest) has it."""
        manifest = manifest or self.manifest()
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.folder}/{name}" for b, name in manifest["files"] if wanted is None or b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lacking(self, batch: DataFrame, manifest: dict) -> DataFrame:
        """One row of each key of the batch that the table does not have, by reading the touched buckets only."""
        held = self.rows(manifest, self.touched(batch, manifest)).select(self.key)
        return batch.dropDuplicates([self.key]).join(held, self.key, "left_anti")

    def _written(self, rows: DataFrame, manifest: dict) -> list[list]:
        """[bucket, file] of ``rows``, put into a new folder: one file a bucket."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names).withColumn("_bucket", self.bucket(manifest)).repartition(manifest["buckets"], "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        out = []
        for part in self._listed(f"{self.folder}/{name}"):
            own = part.getPath().getName()
            if own.startswith("_bucket="):
                out += [[int(own[8:]), f"{name}/{own}/{s.getPath().getName()}"] for s in self._listed(f"{self.folder}/{name}/{own}") if s.getPath().getName().startswith("part-")]
        return out

    # --- commits

    def attempt(self, manifest: dict, rows: DataFrame, replaced: list[int] = (), run: str | None = None, batch_id: int | None = None) -> dict:
        """Add ``rows``; the ``replaced`` buckets hold nothing else afterwards. Full buckets are merged on the way."""
        gone = set(replaced)
        kept = [f for f in manifest["files"] if f[0] not in gone]
        added = self._written(rows, manifest)
        counts: dict[int, int] = {}
        for b, _ in [*kept, *added]:
            counts[b] = counts.get(b, 0) + 1
        full = {b for b, n in counts.items() if n > self.most_files}
        if full:
            held = [f for f in [*kept, *added] if f[0] in full]
            merged = self._written(self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{name}" for _, name in held)), manifest)
            kept, added = [f for f in kept if f[0] not in full], [f for f in added if f[0] not in full] + merged
        return self.commit(manifest, kept + added, {} if run is None else {run: batch_id})

    def _until_committed(self, once: Callable[[dict], dict | None]) -> dict | None:
        for _ in range(MOST_TRIES):
            try:
                return once(self.manifest())
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: lost {MOST_TRIES} times to other writers")

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        """Replace the touched buckets by ``merge(their rows, batch)``, in one commit."""

        def once(manifest: dict) -> dict:
            buckets = self.touched(batch, manifest)
            return self.attempt(manifest, merge(self.rows(manifest, buckets), batch), buckets)

        return self._until_committed(once)

    def append_batch(self, batch: DataFrame, run: str, batch_id: int, act: Callable[[DataFrame], None]) -> dict | None:
        """``act`` on the batch's rows of new keys, then note these keys and the batch; nothing if the batch was noted before.

        After a lost race or a crash in between, ``act`` is called again, so it must be idempotent by the batch.
        """

        def once(manifest: dict) -> dict | None:
            if manifest["done"].get(run, -1) >= batch_id:
                return None
            new = self.lacking(batch, manifest).persist()
            try:
                act(new)
                return self.attempt(manifest, new, run=run, batch_id=batch_id)
            finally:
                new.unpersist()

        return self._until_committed(once)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep`` and data folders that none of these names; only while no writer runs."""
        found = sorted((s.getPath() for s in self._listed(f"{self.folder}/manifests")), key=lambda p: p.getName())
        named = {"/".join(name.split("/")[:2]) for p in found[-keep:] for _, name in json.loads(self.spark.read.text(p.toString(), wholetext=True).head()[0])["files"]}
        stale = found[:-keep] + [s.getPath() for s in self._listed(f"{self.folder}/data") if f"data/{s.getPath().getName()}" not in named] + [s.getPath() for s in self._listed(f"{self.folder}/pending")]
        for path in stale:
            self.files.delete(path, True)
        return len(stale)
