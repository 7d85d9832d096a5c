"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good (toxic words may add up without end, so they stand at the open end of the scale). One
weight vector over hashed text features, of either sign, gives a score s, ordered thresholds t1 < t2 turn it into
P(grade >= k) = sigmoid(s - t_k) and an expected grade; a document is kept when the tail probability of grade 2 reaches
``KEEP_AT``. Features are the distinct words of the whole text, their first letters (4 to 6) and shares of odd
characters, repeats and capitals; each counts once, whatever the length. The fit is the maximum of the likelihood with
an elastic net, which sets the weights of what tells nothing to 0.

Fitted on at most ``SAMPLE_ROWS`` labelled documents of at most ``SAMPLE_BYTES`` (those whose hashed doc_id is smallest;
a bound of the fit alone), scored on all rows. Of a doc_id's repeated rows the least text is fitted, of its repeated
labels the worst grade. Null texts are empty and get the score of no features; repeated rows get equal scores; null
doc_ids are scored, never fitted. With no labels, or labels of one grade only, nothing is known against any document
and all are kept. Extra columns pass; where one has the name of an added column, the added one's name gets an underscore
at its end. Empty tables give empty results.

A word tells only if labels of both kinds have been seen with it: with some 50 toxic labels most toxic words never are, and
two in five toxic documents pass; with some 500 none of the held-out ones did. Use a thousand labels or more.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_names, frugal, give_back, load, text_or_empty

SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 64 << 20
DIMENSIONS = 1 << 18
KEEP_AT = 0.5
#: Elastic net: of the absolute weights (over the square root of the rows, as noise falls) and of the squared ones.
L1, L2 = 0.18, 1e-4
#: The optimum is told by its conditions, within this part of the penalty.
TOLERANCE = 0.05
MOST_ROUNDS, MOST_STEPS = 30, 300
#: Features that violate the conditions most come into the fit first, so many a round.
MOST_NEW = 400
#: Words whose scores a worker keeps; beyond, the newer half goes, since common words are met early.
MEMO_ENTRIES = 120_000
MEMO_CHARS = 48
SHARE_STEPS = 20
#: Entries that are summed at once.
BLOCK = 1 << 19

_WORD = re.compile(r"[^\W\d_]+")


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (DIMENSIONS - 1)


def word_features(word: str) -> tuple[int, ...]:
    return (hashed("w:" + word), *(hashed(f"p{n}:" + word[:n]) for n in (4, 5, 6) if len(word) > n))


def shape_features(text: str, words: list[str], distinct: int) -> list[int]:
    """Shares in steps of a twentieth, as features of their own."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    capitals = len(re.findall(r"[A-Z]{2,}", text))
    marks = len(re.findall(r"[^\w\s.,;:'\"-]", text))
    tokens = max(1, len(words))
    shares = {
        "letters": letters / n, "capitals": min(1.0, capitals / tokens), "marks": min(1.0, 4 * marks / n), "distinct": distinct / tokens,
        "lines": min(1.0, 4 * text.count("\n") / tokens), "long": min(1.0, letters / tokens / 20), "count": min(1.0, np.log10(tokens) / 5),
    }
    out = []
    for name, share in shares.items():
        step = int(share * SHARE_STEPS)
        out += [hashed(f"{name}={step}"), *(hashed(f"{name}>{k}") for k in range(0, step, 2))]
    return out


class Model:
    """Weights and thresholds; of bounded size, whatever the corpus."""

    def __init__(self, weights: np.ndarray, thresholds: tuple[float, float]):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds
        self.memo: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weights, self.thresholds)

    def score(self, text: str) -> float:
        words = _WORD.findall(text.lower())
        own = set(words)
        memo, total = self.memo, 0.0
        for w in own:
            s = memo.get(w)
            if s is None:
                s = float(self.weights[list(word_features(w))].sum())
                if len(w) <= MEMO_CHARS:
                    memo[w] = s
            total += s
        if len(memo) > MEMO_ENTRIES:
            for w in list(memo)[MEMO_ENTRIES // 2 :]:
                del memo[w]
        return total + float(self.weights[shape_features(text, words, len(own))].sum())

    def tails(self, score: float) -> tuple[float, float]:
        return tuple(1.0 / (1.0 + np.exp(-np.clip(score - t, -40, 40))) for t in self.thresholds)


def features(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    own = set(words)
    found = [f for w in own for f in word_features(w)]
    return np.unique(np.asarray(found + shape_features(text, words, len(own)), dtype=np.int32))


def summed(into: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values[of]`` by ``into``, block by block: whole, the wide copies would be many times what is held."""
    out = np.zeros(n)
    for a in range(0, len(into), BLOCK):
        out += np.bincount(into[a : a + BLOCK], weights=values[of[a : a + BLOCK]], minlength=n)
    return out


class Likelihood:
    """Weighted mean of the negative log likelihood of grades, for rows of features (each feature once a row)."""

    def __init__(self, rows: list[np.ndarray], grades: list[int]):
        self.grades = np.asarray(grades)
        n = len(self.grades)
        share = np.bincount(self.grades, minlength=3) / n
        cost = (np.minimum(4.0, 1 / np.maximum(3 * share, 1e-9)) ** 0.5)[self.grades]  # rare grades weigh more
        self.cost = cost / cost.mean()
        at_least = np.clip([share[1] + share[2], share[2]], 0.01, 0.99)
        first, second = -np.log(at_least / (1 - at_least))
        self.start = np.array([first, np.log(max(second - first, 0.1))])
        found = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        present = np.zeros(DIMENSIONS, dtype=bool)
        present[found] = True
        self.features, place = np.flatnonzero(present), np.cumsum(present, dtype=np.int32) - 1
        self.column = place[found].astype(np.int32)
        self.row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])

    def parts(self, scores: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, derivative by each row's score, derivative by (t1, log(t2 - t1))."""
        gap = np.exp(cuts[1])
        p1, p2 = (1 / (1 + np.exp(-np.clip(scores - t, -40, 40))) for t in (cuts[0], cuts[0] + gap))
        d1, d2, g, n = p1 * (1 - p1), p2 * (1 - p2), self.grades, len(self.grades)
        like = np.maximum(np.choose(g, [1 - p1, p1 - p2, p2]), 1e-12)
        weight = self.cost / like / n
        by_first, by_second = weight * np.choose(g, [-d1, d1, 0 * d1]), weight * np.choose(g, [0 * d2, -d2, d2])
        by_cut = np.array([(by_first + by_second).sum(), by_second.sum() * gap])
        return float(-(self.cost * np.log(like)).sum() / n), -(by_first + by_second), by_cut

    def gradient(self, by_score: np.ndarray) -> np.ndarray:
        return summed(self.column, by_score, self.row, len(self.features))


def _descend(data: Likelihood, active: np.ndarray, weights: np.ndarray, cuts: np.ndarray, l1: float, l2: float):
    """Accelerated proximal gradient over the active columns."""
    place = np.full(len(data.features), -1, dtype=np.int32)
    place[active] = np.arange(len(active))
    column = place[data.column]
    active_ones = column >= 0
    column, row, n = column[active_ones], data.row[active_ones], len(data.grades)

    def at(w, c):
        value, by_score, by_cut = data.parts(summed(row, w, column, n), c)
        return value + l2 / 2 * (w @ w), summed(column, by_score, row, len(w)) + l2 * w, by_cut

    w, c = weights[active], cuts
    v, vc, speed, curve = w, c, 1.0, 1.0
    for _ in range(MOST_STEPS):
        value, by_w, by_c = at(v, vc)
        while True:
            step = v - by_w / curve
            new, new_c = np.sign(step) * np.maximum(np.abs(step) - l1 / curve, 0), vc - by_c / curve
            off, off_c = new - v, new_c - vc
            if at(new, new_c)[0] <= value + by_w @ off + by_c @ off_c + curve / 2 * (off @ off + off_c @ off_c) + 1e-12:
                break
            curve *= 2
        still = max(np.abs(off).max(initial=0), np.abs(off_c).max()) * curve < TOLERANCE * l1
        if (v - new) @ (new - w) + (vc - new_c) @ (new_c - c) > 0:
            v, vc, speed = new, new_c, 1.0
        else:
            faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            v, vc, speed = new + (speed - 1) / faster * (new - w), new_c + (speed - 1) / faster * (new_c - c), faster
        w, c, curve = new, new_c, curve * 0.9
        if still:
            break
    return w, c


def optimum(data: Likelihood, l1: float, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights (of data.features) and cuts that minimise data + l1 |w| + l2 / 2 w²: columns come into the fit as they violate its conditions."""
    weights, cuts = np.zeros(len(data.features)), data.start
    active = np.zeros(0, dtype=np.int64)
    for _ in range(MOST_ROUNDS):
        scores = summed(data.row, weights, data.column, len(data.grades))
        slope = np.abs(data.gradient(data.parts(scores, cuts)[1]))
        slope[active] = 0
        new = np.argsort(-slope, kind="stable")[:MOST_NEW]
        new = new[slope[new] > l1 * (1 + TOLERANCE)]
        if not len(new) and len(active):
            break
        active = np.sort(np.concatenate([active, new]))
        weights[active], cuts = _descend(data, active, weights, cuts, l1, l2)
    return weights, cuts


def fit(texts: list[str], grades: list[int]) -> Model | None:
    """Penalised maximum likelihood of the cumulative-link model; None where there is nothing to tell apart."""
    if len(set(grades)) < 2:
        return None
    data = Likelihood([features(t) for t in texts], grades)
    found, cuts = optimum(data, L1 / np.sqrt(len(grades)))
    weights = np.zeros(DIMENSIONS)
    weights[data.features] = found
    return Model(weights, (float(cuts[0]), float(cuts[0] + np.exp(cuts[1]))))


def grade(quality, toxic):
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """The model of a bounded sample; only doc_ids and sizes are collected before it is known to fit the bounds."""
    spark = docs.sparkSession
    picked = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0)))).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(picked), "doc_id")
    sizes = rows.groupBy("doc_id", "grade").agg(F.max(F.octet_length("_text")).alias("size")).withColumn("h", F.xxhash64("doc_id")).collect()
    total, sample = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["size"]
        if total > sample_bytes:
            break
        sample.append((r["doc_id"], r["grade"]))
    if not sample:
        return None
    wanted = spark.createDataFrame(sample, "_id long, grade int")
    texts = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"))
    got = sorted(texts.groupBy("doc_id", "grade").agg(F.min("_text").alias("_text")).collect(), key=lambda r: r["doc_id"])
    model = fit([r["_text"] for r in got], [r["grade"] for r in got])
    del got
    give_back()
    return model


ADDED = (("expected_grade", "double"), ("p_harmless", "double"), ("p_good", "double"), ("keep", "boolean"))


def _tails(model: Model | None, texts) -> list[tuple[float, float]]:
    """Text by text, so that only one is held as a string."""
    return [(1.0, 1.0) if model is None else model.tails(model.score(t.as_py() or "")) for t in texts]


def _with_text(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, int]:
    """``carry``, and the place of a column that holds the text: one of them, if it can."""
    if "text" in carry and dict(docs.dtypes)["text"] == "string":
        return docs.select(*carry), carry.index("text")
    return docs.select(*carry, text_or_empty().alias("_text_")), len(carry)


def graded(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with expected_grade, p_harmless, p_good and keep."""
    carry = docs.columns if carry is None else carry
    schema = T.StructType([*docs.select(*carry).schema.fields])
    for name, (_, kind) in zip(free_names(carry, [n for n, _ in ADDED]), ADDED, strict=True):
        schema = schema.add(name, kind)
    source, at = _with_text(docs, carry)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tails = _tails(model, batch.column(at))
                cols = [pa.array([x + y for x, y in tails], pa.float64()), pa.array([x for x, _ in tails], pa.float64()), pa.array([y for _, y in tails], pa.float64())]
                cols.append(pa.array([y >= keep_at for _, y in tails], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), *cols], names=[f.name for f in schema.fields])

    return source.mapInArrow(frugal(run), schema)


def keep_good(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` whose tail probability of grade 2 reaches ``keep_at``, as they are."""
    schema = docs.schema
    source, at = _with_text(docs, docs.columns)

    def run(batches):
        for batch in batches:
            keep = [y >= keep_at for _, y in _tails(model, batch.column(at))]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in range(len(schema))], names=schema.names)

    return source.mapInArrow(frugal(run), schema)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return graded(docs, train(docs, load(spark, sf_dir, "labels")), carry=["doc_id"])
