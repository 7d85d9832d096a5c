"""The bucketed ledger: whole commits, lost writers, two at once, bounded reads; clustered pages."""

import threading

import pytest
from pyspark.sql import functions as F

from quoteproof.operators import intake
from quoteproof.sources.ledger import Conflict, Ledger
from quoteproof.streaming import wrappers

SHAPE = "key long, attempts long, status string"


def ledger(spark, folder, **bounds):
    return Ledger(spark, str(folder), spark.createDataFrame([], SHAPE).schema, "key", **bounds)


def merge(old, batch):
    return intake.upsert_ledger(old, batch, "key")


def content(table):
    return {r.key: (r.attempts, r.status) for r in table.rows().collect()}


def calls(spark, *keys, succeeded=False):
    return spark.createDataFrame([(k, succeeded) for k in keys], "key long, succeeded boolean")


def test_upsert(spark, tmp_path):
    table = ledger(spark, tmp_path / "t", buckets=4)
    assert content(table) == {}
    table.upsert(calls(spark, 1, 1, 2), merge)
    table.upsert(calls(spark, 2, succeeded=True), merge)
    table.upsert(calls(spark, 2, 3), merge)
    assert content(table) == {1: (2, "pending"), 2: (2, "succeeded"), 3: (1, "pending")}
    assert table.manifest()["version"] == 3 and len(table.manifest()["files"]) <= 4
    assert table.vacuum() > 0 and content(table)[2] == (2, "succeeded")


def test_a_writer_that_dies_adds_nothing(spark, tmp_path, monkeypatch):
    table = ledger(spark, tmp_path / "t", buckets=4)
    table.upsert(calls(spark, *range(20)), merge)
    before = content(table)

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_put_if_absent", die)  # data files and the manifest's text are written, the manifest is not
        with pytest.raises(OSError, match="lost"):
            table.upsert(calls(spark, *range(10, 30)), merge)
    assert content(table) == before
    table.upsert(calls(spark, *range(10, 30)), merge)
    assert content(table) == {k: (1 + (10 <= k < 20), "pending") for k in range(30)}


def test_of_two_writers_none_is_lost(spark, tmp_path):
    table = ledger(spark, tmp_path / "t", buckets=4)
    stale = table.manifest()
    table.attempt(stale, merge(table.rows(stale), calls(spark, 1)))
    with pytest.raises(Conflict):
        table.attempt(stale, merge(table.rows(stale), calls(spark, 2)))
    threads = [threading.Thread(target=ledger(spark, tmp_path / "t").upsert, args=(calls(spark, *range(10)), merge)) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert content(table) == {k: (4 + (k == 1), "pending") for k in range(10)}


def test_late_batches_read_no_more_than_early_ones(spark, tmp_path):
    table, most = ledger(spark, tmp_path / "t", buckets=2, most_files=3), []
    for n in range(12):
        batch = spark.createDataFrame([(k, 1, "pending") for k in range(n * 5, n * 5 + 8)], SHAPE)
        manifest = table.manifest()
        most.append(len(table.rows(manifest, table.touched(batch, manifest)).inputFiles()))
        assert table.append_batch(batch, "run", n, lambda new: None) is not None
        assert table.append_batch(batch, "run", n, pytest.fail) is None  # the same batch again
    assert max(most) <= 2 * 3 and most[-1] <= 6
    assert sorted(r.key for r in table.rows().collect()) == list(range(63))


def test_a_crash_between_results_and_ledger(spark, tmp_path, monkeypatch):
    spark.range(30).select((F.col("id") % 10).alias("key")).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    drain = lambda: wrappers.run_into(wrappers.file_stream(spark, str(tmp_path / "in"), "key long"), lambda new: new, str(tmp_path / "cp"), out, "key")
    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            drain()
    drain()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == list(range(10))
