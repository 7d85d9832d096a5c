"""Outward sinks: a REST endpoint under an idempotency key, an allow-listed log, and blobs on any Hadoop file system."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys that may be logged, the endpoint's path.
LOGGED = ("requestId", "jobId", "companyId", "documentId", "attempt", "code", "status", "durationMs", "count", "names")
SUBMIT_PATH = "/v1/quote-requests"
ANSWER = "request_id string, http_status int, transport_error string, answer string"


def log_line(level: str, event: str, row: DataFrame) -> Column:
    """JSON of the row's allowed columns; no other column can leak."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *(F.col(c) for c in row.columns if c in LOGGED), F.lit(event).alias("msg")))


def post(url: str, token: str, key: str, body: str, timeout: float) -> tuple[int | None, str | None, str | None]:
    """(status, transport error, answer) of one call. An answer that breaks off has a status and an error: its outcome is unknown."""
    headers = {"authorization": f"Bearer {token}", "content-type": "application/json", "idempotency-key": key}
    status = None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body.encode(), headers=headers, method="POST"), timeout=timeout) as answer:  # noqa: S310
            status = answer.status
            return status, None, answer.read().decode("utf-8", errors="replace")
    except urllib.error.HTTPError as e:
        return e.code, None, None
    except TimeoutError:
        return status, "timeout", None
    except OSError as e:
        return status, "timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else "unreachable", None


def submit(payloads: DataFrame, base_url: str, token: str, timeout: float = 10.0) -> DataFrame:
    """Calls the endpoint for each (request_id, body); a repeated call carries the same key, so it is safe. For ``foreachBatch``,
    behind a ledger that leaves out what is done."""
    if not token:
        raise ValueError("a token is needed")
    url = base_url.rstrip("/") + SUBMIT_PATH

    def run(frames):
        for frame in frames:
            rows = [(key, *post(url, token, key, body, timeout)) for key, body in zip(frame["request_id"], frame["body"], strict=True)]
            yield pd.DataFrame(rows, columns=["request_id", "http_status", "transport_error", "answer"]).astype({"http_status": "Int32"})

    return payloads.select("request_id", "body").mapInPandas(run, ANSWER)


class BlobStore:
    """Bytes under keys below a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, key: str):
        if key.startswith("/") or ".." in key.split("/"):
            raise ValueError("a key stays below the folder")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def put(self, key: str, data: bytes) -> None:
        fs, path = self._path(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        rows = self.spark.read.format("binaryFile").load(f"{self.folder}/{key}").select("content").collect()
        return bytes(rows[0]["content"])

    def table(self, pattern: str = "*") -> DataFrame:
        """path, length, content of all blobs whose name matches; the distributed way to read many."""
        return self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(self.folder).select("path", "length", "content")

    def delete(self, key: str) -> bool:
        fs, path = self._path(key)
        return bool(fs.delete(path, False))


def json_names(line: str) -> set[str]:
    """The keys of a log line."""
    return set(json.loads(line))
