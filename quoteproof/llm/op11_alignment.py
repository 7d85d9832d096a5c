"""Cross-tokenizer alignment by common byte offsets.

Both tokenizers cut the same bytes (a blank and the text). The cumulative sums of the tokens' byte lengths are the offsets
at which they end; the offsets where tokens of both end (``intersect1d``) cut a text into groups, and ``searchsorted``
gives each token its group. Every pair of an A and a B token that end at the same offset is a link; pairs are made by
repeating each offset as often as it has pairs. A first pass over the texts writes, for each document, its figures and its
links as a histogram of id pairs, and for each task the sums of all its histograms; these sums meet in a salted two-stage
aggregation. A linked pair is a token of one vocabulary and a suffix of it in the other, so there are at most as many
different pairs as the entries of both vocabularies have bytes (``most_pairs``), whatever the corpus: their counts are
broadcast to a second pass, which reads only the histograms.

Texts that are null or empty, or whose joined A or B bytes differ from blank + text (a text with U+2581, which B reads as a blank),
have no tokens: zeros and an empty digest. Long texts are taken in runs that begin at single blanks, where both
tokenizers begin a token. Repeated rows are rows of their own and count each; null ids are kept; extra columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._encode import _VISIBLE, encoder, piece_encoder, text_blocks, tokenizer_path
from ._shared import KEPT, frugal, load, materialise, text_or_empty

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a text that are aligned at once.
RUN_CHARS = 400_000
#: Parts in which a frequent pair's counts meet first.
SALTS = 16

STATE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair long, n long"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
_BREAK = re.compile("(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    entries = {**config["model"]["vocab"], **{t["content"]: t["id"] for t in config.get("added_tokens", [])}}
    of_char = {chr(c): b for b, c in _VISIBLE.items()} | {chr(b): b for b in range(256) if b not in _VISIBLE}
    out = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        out[i] = bytes(of_char[c] for c in token)
    return out


def piece_bytes(pieces: list[str]) -> list[bytes]:
    return [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


def runs_of(text: str, most: int = RUN_CHARS) -> list[str]:
    """The text in runs of about ``most`` characters, without the single blanks between them."""
    out, start = [], 0
    while len(text) - start > most:
        cut = _BREAK.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


class Aligner:
    """Groups and links of texts under two tokenizers."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = encoder(byte_level, plain=True), piece_encoder(pieces)
        self.bytes_a, self.bytes_b = byte_level_bytes(byte_level), piece_bytes(self.b.pieces)
        self.lengths_a, self.lengths_b = (np.asarray([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        ends = (b",", b"|"), (b",", b";")
        self.written = [b"%d%s" % (i, e) for n, two in zip((len(self.bytes_a), len(self.bytes_b)), ends, strict=True) for i in range(n) for e in two]

    def most_pairs(self) -> int:
        """Different pairs that can be linked at most: one token's bytes end the other's."""
        a, b = set(self.bytes_a), set(self.bytes_b)
        ends = lambda tokens, others: sum(t[k:] in others for t in tokens for k in range(len(t)))
        return ends(self.bytes_a, b) + ends(self.bytes_b, a)

    def align(self, texts: list[str]) -> list[tuple | None]:
        """For each text (n_a, n_b, n_groups, n_links, written groups, pairs, times), or None where it has no tokens."""
        found = []
        for text, a, b in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts), strict=True):
            ids_a, ids_b = np.frombuffer(a, dtype="<u4").astype(np.int64), np.frombuffer(b, dtype="<u4").astype(np.int64)
            want = b" " + text.encode()
            same = text and all(b"".join(map(t.__getitem__, i.tolist())) == want for t, i in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
            found.append((ids_a, ids_b) if same else None)
        out: list[tuple | None] = [None] * len(texts)
        sound = [k for k, x in enumerate(found) if x is not None]
        if sound:
            for k, got in zip(sound, self._aligned([found[k][0] for k in sound], [found[k][1] for k in sound]), strict=True):
                out[k] = got
        return out

    def _aligned(self, each_a: list[np.ndarray], each_b: list[np.ndarray]):
        a, b = np.concatenate(each_a), np.concatenate(each_b)
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        cuts = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        stop_a, stop_b = np.cumsum([len(x) for x in each_a]), np.cumsum([len(x) for x in each_b])
        doc_of_cut = np.searchsorted(ends_a[stop_a - 1], cuts)
        # tokens that end at a cut, by cut; each offset is repeated once a pair
        at_a, at_b = np.flatnonzero(cuts[group_a] == ends_a), np.flatnonzero(cuts[group_b] == ends_b)
        many_a, many_b = np.bincount(group_a[at_a], minlength=len(cuts)), np.bincount(group_b[at_b], minlength=len(cuts))
        many = many_a * many_b
        cut = np.repeat(np.arange(len(cuts)), many)
        nth = np.arange(len(cut)) - np.repeat(np.cumsum(many) - many, many)
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        link_a, link_b = a[at_a[first_a[cut] + nth // many_b[cut]]], b[at_b[first_b[cut] + nth % many_b[cut]]]
        pair = link_a * len(self.bytes_b) + link_b
        span = len(self.bytes_a) * len(self.bytes_b)
        keys, times = np.unique(doc_of_cut[cut] * span + pair, return_counts=True)
        docs = np.arange(len(each_a) + 1)
        slices = np.searchsorted(keys, docs * span)
        links, groups = np.bincount(doc_of_cut[cut], minlength=len(each_a)), np.bincount(doc_of_cut, minlength=len(each_a))
        # the groups in writing: A ids, then B ids, of one group after the other
        sizes_a, sizes_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = 2 * a + (np.append(group_a[1:], -1) != group_a)
        order[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = 2 * (len(self.bytes_a) + b) + (np.append(group_b[1:], -1) != group_b)
        start = 0
        for k, stop in enumerate((stop_a + stop_b).tolist()):
            written = b"".join(map(self.written.__getitem__, order[start:stop].tolist()))[:-1]
            start = stop
            mine = slice(slices[k], slices[k + 1])
            yield len(each_a[k]), len(each_b[k]), int(groups[k]), int(links[k]), written, keys[mine] - k * span, times[mine]

    def document(self, runs: list[str]) -> tuple | None:
        """``align`` of one long text, run by run."""
        sums, digest, pairs, times = np.zeros(4, dtype=np.int64), hashlib.sha256(), [], []
        for k, run in enumerate(runs):
            got = self.align([run])[0]
            if got is None:
                return None
            sums += got[:4]
            digest.update((b";" if k else b"") + got[4])
            pairs.append(got[5])
            times.append(got[6])
        keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
        return (*sums.tolist(), digest.hexdigest(), keys, np.bincount(at, weights=np.concatenate(times)).astype(np.int64))


_ALIGNERS: dict[tuple[str, str], Aligner] = KEPT.setdefault("aligners", {})


def aligner(byte_level: str, pieces: str) -> Aligner:
    key = (byte_level, pieces)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(byte_level, pieces)
    return _ALIGNERS[key]


def _first_pass(byte_level: str, pieces: str):
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in STATE.split(", ")]

    def one(got):
        if got is None:
            return (0, 0, 0, 0, "", b"", b""), None
        n_a, n_b, groups, links, written, pairs, times = got
        digest = written if isinstance(written, str) else hashlib.sha256(written).hexdigest()
        return (n_a, n_b, groups, links, digest, pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()), (pairs, times)

    def run(batches):
        tool = aligner(byte_level, pieces)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids = batch.column("doc_id")
            for start, stop, texts in text_blocks(batch.column("_text"), RUN_CHARS):
                found = tool.align([t if len(t) <= RUN_CHARS else "" for t in texts])
                for k, text in enumerate(texts):
                    if len(text) > RUN_CHARS:
                        found[k] = tool.document(runs_of(text, RUN_CHARS))
                rows = []
                for got in found:
                    row, pair = one(got)
                    rows.append(row)
                    if pair:
                        pending.append(pair)
                if len(pending) > 64:
                    pending = [_merged(pending)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:8], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *columns, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
        if pending:
            pairs, times = _merged(pending)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), k) for k in kinds[:8]), pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], names=names)

    return run


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), dtype=np.int64)
    np.add.at(sums, at, np.concatenate([t for _, t in parts]))
    return keys, sums


def pair_counts(state: DataFrame) -> DataFrame:
    """(pair, n): the links of each id pair in the whole corpus, from the tasks' sums."""
    sums = state.where("pair is not null").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return sums.groupBy("pair", "_salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def _second_pass(counts, names: list[str]):
    def run(batches):
        keys, n, best = counts.value
        for batch in batches:
            n_best, sums = [], []
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                at, times = np.searchsorted(keys, np.frombuffer(p, dtype="<u4")), np.frombuffer(t, dtype="<u4").astype(np.int64)
                n_best.append(int(times[best[at]].sum()))
                sums.append(int((times * n[at]).sum()))
            own = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names=names)

    return run


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row per document: tokens of both, groups, links, links that are their B id's most frequent, their counts' sum, the groups' digest."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    state = materialise(texts.mapInArrow(frugal(_first_pass(byte_level, pieces), "aligners", "encoders", "pieces"), STATE), "aligned")
    table = pair_counts(state).toArrow()  # at most ``most_pairs`` rows, a bound of the vocabularies
    keys, n = (np.asarray(table.column(c).combine_chunks(), dtype=np.int64) for c in ("pair", "n"))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    b = keys % len(piece_encoder(pieces).pieces)
    top = np.zeros(b.max(initial=-1) + 1, dtype=np.int64)
    np.maximum.at(top, b, n)
    counts = spark.sparkContext.broadcast((keys, n, n == top[b]))
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    figures = state.where("pairs is not null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return figures.mapInArrow(frugal(_second_pass(counts, names)), ALIGNED)


def op11_common_cut_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(load(spark, sf_dir, "documents"), tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES))
