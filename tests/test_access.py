"""Clustered lists, the tenant guard, recorded answers and a receiver that gets full."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quoteproof.operators import evaluation, export
from quoteproof.session import TenantSession, unscoped
from quoteproof.sources.clustered import ClusteredList

START = dt.datetime(2024, 1, 1)


def test_pages_of_a_clustered_list(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 2, 2, 2, 3]), None if k % 50 == 0 else START + dt.timedelta(hours=rng.randint(0, 300)), k) for k in range(3000)] + [(9, START, 1)]
    table = ClusteredList(spark, str(tmp_path / "t"), "company", "at", "id")
    table.write(spark.createDataFrame(rows, "company int, at timestamp, id int").repartition(5), 40)
    for tenant in (1, 2, 9, 77):
        want = sorted((r for r in rows if r[0] == tenant), key=lambda r: (r[1] is None, r[1] or START, r[2]), reverse=True)
        seen, cursor = [], None
        for _ in range(4):
            page = table.page(tenant, cursor)
            got = [tuple(r) for r in page.collect()]
            assert len(page.inputFiles() if got else []) <= 3  # of 40 files
            seen += got[:50]
            if len(got) <= 50:
                break
            cursor = got[49][1:]
        assert seen == want[: len(seen)] and len(seen) == min(len(want), 200)


def test_files_read_for_a_page(spark, tmp_path):
    table = ClusteredList(spark, str(tmp_path / "t"), "company", "at", "id")
    table.write(spark.range(20_000).select(F.lit(1).alias("company"), F.timestamp_seconds("id").alias("at"), "id"), 100)
    page = table.page(1, (START.replace(1970, 1, 1) + dt.timedelta(seconds=9000), 9000))
    assert [r.id for r in page.collect()] == list(range(8999, 8948, -1))
    assert len(page.inputFiles()) <= 2


@pytest.fixture(scope="module")
def company(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tenants"))
    for name in ("requests", "documents"):
        spark.range(40).select((F.col("id") % 4).cast("string").alias("company_id"), F.col("id").alias(f"{name}_id")).write.parquet(f"{folder}/{name}")
    spark.range(5).write.parquet(f"{folder}/countries")
    return folder, TenantSession(lambda name: spark.read.parquet(f"{folder}/{name}"), "2", pattern=r"^\d+$")


def test_scoped_plans_pass(spark, company):
    folder, session = company
    requests, documents = session.table("requests"), session.table("documents")
    countries = spark.read.parquet(f"{folder}/countries")
    joined = requests.join(documents, "company_id").join(countries, F.col("id") == F.col("requests_id")).groupBy("company_id").count()
    assert session.check(joined).collect() is not None
    raw = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert session.check(raw("requests").select("company_id", "requests_id").where("company_id = '2' and requests_id > 3")).count() == 9
    both = raw("requests").alias("r").join(raw("documents").alias("d"), F.col("r.requests_id") == F.col("d.documents_id")).where("r.company_id = '2' and d.company_id = '2'")
    assert session.check(both).count() == 10


def test_reads_beside_the_session_are_refused(spark, company):
    folder, session = company
    raw = lambda name: spark.read.parquet(f"{folder}/{name}")
    spark.read.parquet(f"{folder}/documents").createOrReplaceTempView("documents_beside")
    own = session.table("requests")
    beside = [
        raw("requests"), raw("requests").where("company_id = '3'"), raw("requests").where("company_id = '2' or requests_id = 1"), own.union(raw("requests")),
        own.join(raw("documents"), F.col("requests_id") == F.col("documents_id")), raw("requests").limit(5).where("company_id = '2'"),
        raw("requests").groupBy("company_id").count().where("company_id = '2'"), spark.sql("SELECT (SELECT count(*) FROM documents_beside) AS n"),
        spark.sql("SELECT * FROM documents_beside WHERE company_id = '2' AND documents_id IN (SELECT documents_id FROM documents_beside)"),
    ]
    for df in beside:
        with pytest.raises(PermissionError, match="requests|documents"):
            session.check(df)
    assert unscoped(own, None, "company_id") and not unscoped(own, "2", "company_id")
    assert unscoped(raw("countries"), "2", "company_id", {"/countries": "company_id"})  # a listed table without the column
    with pytest.raises(PermissionError):
        TenantSession(raw, None).check(TenantSession(raw, None).table("requests"))


def test_recorded_answers(spark):
    prompts = spark.createDataFrame([(1, "one"), (2, "two"), (3, None), (4, "one")], "case_id int, prompt string")
    sha = F.sha2(F.col("p").cast("binary"), 256).alias("prompt_hash")
    recorded = spark.createDataFrame([("one", "old", 1), ("one", "new", 2), ("other", "x", 3)], "p string, response string, recorded_at int").select(sha, "response", "recorded_at")
    got = {r.case_id: (r.response, r.error) for r in evaluation.replayed(prompts, recorded).collect()}
    assert got == {1: ("new", None), 2: (None, "replay_missing"), 3: (None, "replay_missing"), 4: ("new", None)}


@pytest.mark.parametrize("most", [0, 2, 5, 9, 100])
def test_a_full_receiver(spark, most):
    rng = random.Random(most)
    known = {f"k{n}": "a" for n in range(4)}
    calls = [(f"k{rng.randint(0, 14)}", n * 10**9, rng.choice("ab")) for n in rng.sample(range(1000), 120)]
    store, want = dict(known), {}
    for key, nth, body in sorted(calls, key=lambda c: c[1]):
        if key in store:
            want[nth] = 200 if store[key] == body else 409
        elif len(store) >= most:
            want[nth] = 503
        else:
            store[key], want[nth] = body, 201
    frames = spark.createDataFrame(list(known.items()), "key string, body_hash string"), spark.createDataFrame(calls, "key string, nth long, body_hash string")
    assert {r.nth: r.status for r in export.bounded_receiver(*frames, most).collect()} == want


def test_nth_smallest(spark):
    rng = random.Random(3)
    numbers = sorted({rng.randint(-(2**62), 2**62) for _ in range(500)} | set(range(100)))
    frame = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [export.nth_smallest(frame, "n", k, ranges=64) for k in (1, 2, 250, 300, 600)] == [numbers[0], numbers[1], numbers[249], numbers[299], numbers[599]]
    assert export.nth_smallest(frame, "n", len(numbers) + 1) is None and export.nth_smallest(frame.limit(0), "n", 1) is None
