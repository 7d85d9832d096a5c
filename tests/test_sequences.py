"""Ordered folds by key: the upload cap and the status machine, against plain loops."""

import collections
import datetime as dt
import random

import numpy as np
import pytest

from quoteproof.operators import intake, requests
from quoteproof.schema import TRANSITIONS

START = dt.datetime(2024, 3, 1)


def plain_cap(rows, cap, span):
    accepted, out = collections.defaultdict(list), {}
    for tenant, person, at, key in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[2], r[3])):
        mine = accepted[tenant, person]
        before = sum(a >= at - span for a in mine)
        out[key] = (before, before >= cap)
        if before < cap:
            mine.append(at)
    return {**{r[3]: (0, cap <= 0) for r in rows if None in r[:3]}, **out}


@pytest.mark.parametrize("cap", [0, 1, 2, 5])
def test_cap_counts_accepted_uploads_only(spark, cap):
    rng = random.Random(cap)
    rows = [(rng.choice("ab"), rng.randint(0, 8), START + dt.timedelta(minutes=20 * rng.randint(0, 400)), k) for k in range(1200)]
    rows += [("hot", 1, START + dt.timedelta(seconds=rng.randint(0, 40_000)), 2000 + k) for k in range(4000)]
    rows += [(None, 1, START, 9000), ("a", None, START, 9001), ("a", 1, None, 9002)]
    frame = spark.createDataFrame(rows, "company string, person int, at timestamp, id int").repartition(3)
    for batch in ("10000", "64"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.id: (r.before, r.refused) for r in requests.within_cap(frame, ["company", "person"], "at", "id", cap).collect()}
        assert got == plain_cap(rows, cap, dt.timedelta(hours=1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_refused_uploads_are_not_stored(spark):
    """By hand: every 20 minutes under a cap of 2; the third and fourth are refused, the fifth and sixth are not."""
    frame = spark.createDataFrame([("c", "p", START + dt.timedelta(minutes=20 * k), k) for k in range(10)], "company string, person string, at timestamp, id int")
    got = sorted((r.id, r.refused) for r in requests.within_cap(frame, ["company", "person"], "at", "id", 2).collect())
    assert [k for k, refused in got if not refused] == [0, 1, 4, 5, 8, 9]


def plain_fold(rows, start, table):
    to, out = {(e, a): b for e, a, b in table}, {}
    for key, _, _, event in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        state, bad = out.get(key, (start, 0))
        out[key] = (to[event, state], bad) if (event, state) in to else (state, bad + 1)
    return out


@pytest.mark.parametrize("batch", ["10000", "50"])
def test_fold_is_a_composition(spark, batch):
    rng = random.Random(7)
    events = [e for e, _, _ in TRANSITIONS] + ["unknown", None]
    rows = [(rng.choice(["a", "b", "c", None]) if k % 3 else "hot", rng.randint(0, 3000), k, rng.choice(events)) for k in range(9000)]
    rows += [(f"k{k}", 1, 10_000 + k, "processing.started") for k in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    frame = spark.createDataFrame(rows, "id string, at int, n int, event string").repartition(5)
    folded = intake.fold(frame, "id", ["at", "n"], "event", "NEW")
    assert {r.id: (r.status, r.illegal_steps) for r in folded.collect()} == plain_fold(rows, "NEW", TRANSITIONS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    assert intake.fold(frame.limit(0), "id", ["at", "n"], "event", "NEW").count() == 0


def test_a_key_of_many_events_lies_in_many_tasks(spark):
    frame = spark.range(200_000).selectExpr("'hot' as id", "id as at", "IF(id % 2 = 0, 'processing.started', 'unknown') as event")
    rows = intake.fold(frame, "id", ["at"], "event", "NEW").collect()
    assert [(r.status, r.illegal_steps) for r in rows] == [("PROCESSING", 100_000)]
    _, _, to, illegal = intake.state_table("NEW", TRANSITIONS)
    codes = np.random.default_rng(1).integers(0, len(to), 4097)
    ends, bad = intake.composed(np.arange(4097) == 0, codes, to, illegal)
    for state in range(to.shape[1]):
        now, n = state, 0
        for c in codes:
            n, now = n + illegal[c, now], to[c, now]
        assert ends[0, state] == now and bad[0, state] == n


def test_stream_gives_the_batch_fold(spark, tmp_path):
    """Two drains with a restart between them; some events of the first hour's end come with the second drain."""
    from quoteproof.streaming import status

    spark.conf.set(*status.STORE)
    rng = random.Random(9)
    events = [e for e, _, _ in TRANSITIONS] + ["unknown", None]
    rows = [(f"k{rng.randint(0, 5)}", START + dt.timedelta(minutes=rng.randint(0, 600)), k, rng.choice(events)) for k in range(400)]
    cut = START + dt.timedelta(minutes=300)
    early = [r for r in rows if r[1] < cut and not (r[1] > cut - dt.timedelta(minutes=40) and r[2] % 2)]
    late = [r for r in rows if r not in early]
    schema, folder, seen = "id string, at timestamp, n long, event string", str(tmp_path / "in"), []
    closing = [("end", START + dt.timedelta(days=3), 0, None)]
    for part in (early, late, closing):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        machine = status.folded_stream(source, "id", "at", "n", "event", "NEW")
        writer = machine.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect()))
        writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = {r.key: (r.status, r.illegal_steps) for r in seen}
    assert last == plain_fold(rows, "NEW", TRANSITIONS)
    assert len(seen) > len(last)  # the first drain has already answered what its watermark had passed
