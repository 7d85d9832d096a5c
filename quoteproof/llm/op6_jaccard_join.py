"""N-gram Jaccard join by PartEnum signatures, exact.

Sets of similar size share a band. Two sets of a band (or of neighbouring bands) with Jaccard >= 0.8 differ in at
most k = (|r| + |s|) / 9 elements. The feature domain is partitioned in n1 parts of n2 smaller ones; by the pigeonhole
principle some part holds at most k2 of the differences, so a subset of n2 - k2 of its smaller parts agrees wholly.
Each set sends one signature for each subset; sets that share none cannot be similar. n1 is chosen a little above
the bound, so that the agreeing subset may be taken to be non-empty; sets with too many empty subsets send those too,
which keeps the join exact.

Equal sets are one class, which its smallest doc_id stands for. A signature's documents (its bucket) are not paired
off; documents that meet within a block of a task are linked to the first of them, which alone is sent on. Each is compared with the first of its bucket (one row a document), links make components, and only buckets that
still hold several components compare documents of different ones, of any two components the nearest first. Before
the exact comparison, parity sketches (bits that every difference flips) discard pairs whose sketches already differ
too much, which is again exact. Where a bucket is large, its members of the commonest component and the others are
dealt out in blocks, and each task compares two blocks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null, empty and blank texts have no shingles and no links.
doc_id names a document: repeated rows are the same document, and one with differing texts has the links of all of
them (n_shingles is each row's own). Rows without doc_id are returned with a null component and linked with nothing.
Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._encode import text_blocks
from ._shared import SPACE_BYTES, discard, free_names, frugal, likely, load, materialise, text_or_empty

N = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Largest to smallest size of a band, in per cent. Wider ones send fewer signatures, but of fewer elements each.
BAND = 125
#: Signatures are 56 bits wide, seven bytes each where they are stored.
SIG_BYTES = 7
#: They are dealt out in so many shares, one after the other, so that only one share's shuffle is on disk at a time.
DEALS = 4
#: So many bytes of them are made into rows at a time.
DEAL_BYTES = 4 << 20
SHARES = [f"sigs{k}" for k in range(DEALS)]
#: Keys of classes that a task remembers in order to send the signatures of a class once; more of them start it anew.
SEEN_KEYS = 500_000
#: Sketches have so many bits for each element, up to the next power of two; short ones a single bit.
SKETCH_BITS = 2
#: Every 16th bucket is looked through for links between components first: one pair for each two of its components.
FIRST_SHARE = 16
#: Then all are, for so many pairs of any two components; more, in a further pass, only where these left both unlinked.
MOST_PAIRS = 64
#: Members of a bucket that one task holds of either of the two sides that it compares.
BLOCK = 4096
#: Rows of a bucket from which on pairs are compared by arrays.
BY_ARRAYS = 24

_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_ODD = _mixed(np.arange(1, N + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
#: Bytes of words that are hashed by arrays, eight at a time; longer words are hashed one by one.
LONG_WORD = 64


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes start, and their hashes."""
    import xxhash

    held = np.frombuffer(b" " + data + b" " * 8, dtype=np.uint8)
    space = _IS_SPACE[held]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    out = _mixed(sizes.astype(np.uint64))
    eights = np.lib.stride_tricks.sliding_window_view(held, 8)
    for lane in range(0, LONG_WORD, 8):
        mine = np.flatnonzero(sizes > lane)
        if not len(mine):
            break
        part = eights[starts[mine] + lane].view("<u8").ravel()
        left = np.minimum(sizes[mine] - lane, 8).astype(np.uint64)
        part = part & (_U64(0xFFFFFFFFFFFFFFFF) >> (_U64(64) - _U64(8) * left))
        out[mine] = _mixed((out[mine] * _ODD[0]) ^ part)
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(held[starts[k] : starts[k] + sizes[k]].tobytes())
    return starts - 1, out


def block_shingles(texts: list[str]) -> list[np.ndarray]:
    """For each text the distinct shingles' hashes, sorted; one for a text of fewer than N words."""
    raws = [t.encode() for t in texts]
    starts, h = _word_hashes(b" ".join(raws).lower())
    ends = np.cumsum([len(r) + 1 for r in raws])
    cuts = [0, *np.searchsorted(starts, ends).tolist()]
    m = max(0, len(h) - N + 1)
    total = np.zeros(m, dtype=np.uint64)
    for j in range(N):
        total += h[j : j + m] * _ODD[j]
    total = _mixed(total)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a >= N:
            out.append(np.unique(total[a : b - N + 1]))
        else:
            few = (h[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + _U64(b - a)
            out.append(_mixed(np.array([few] if b > a else [], dtype=np.uint64)))
    return out


def shingles(text: str) -> np.ndarray:
    return block_shingles([text])[0]


def most_differences(n_r: int, n_s: int) -> int:
    """|r| + |s| - 2 |r & s| of similar sets, at most."""
    return (n_r + n_s) * (100 - PERCENT) // (100 + PERCENT)


@cache
def _bands(size: int) -> tuple[int, int, int]:
    """band, its largest size, the next band's largest size; similar sets are in one band or in neighbours."""
    low, band = 1, 0
    while True:
        high = low * BAND // 100
        if size <= high:
            return band, high, (high + 1) * BAND // 100
        low, band = high + 1, band + 1


@cache
def _layout(largest: int) -> tuple[int, int, int, int, np.ndarray]:
    """n1, n2, k2, slack and the subsets (as 0/1 rows) for sets of at most ``largest`` elements."""
    k = most_differences(largest, largest)
    if k <= 3:
        n1, n2, k2, slack = 1, (1, 4, 6, 7)[k], k, 0
    elif k <= 9:
        n1, n2, k2, slack = k // 3 + 2, 5, 2, 1
    else:
        slack = 3 + k // 80
        n1, n2, k2 = k // 2 + 1 + slack, 3, 1
    rows = [[1 if j in c else 0 for j in range(n2)] for c in combinations(range(n2), n2 - k2)]
    return n1, n2, k2, slack, np.array(rows, dtype=np.uint64)


def _signed(jobs: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
    """Signatures of sets in bands, from (set, band, the band's largest size) of one n2 and k2, all at once."""
    _, n2, _, _, subsets = _layout(jobs[0][2])
    layouts = [_layout(largest) for _, _, largest in jobs]
    n1s, slacks = np.array([x[0] for x in layouts]), np.array([x[3] for x in layouts])
    found, sizes = np.concatenate([x for x, _, _ in jobs]), [len(x) for x, _, _ in jobs]
    first = np.concatenate([[0], np.cumsum(n1s)])  # of each job's parts among all
    part = (found >> _U64(33)) % np.repeat(n1s.astype(np.uint64), sizes) + np.repeat(first[:-1].astype(np.uint64), sizes)
    cell = part.astype(np.int64) * n2 + ((found & _U64(0xFFFFFFF)) % _U64(n2)).astype(np.int64)
    sums = np.zeros(int(first[-1]) * n2, dtype=np.uint64)
    np.add.at(sums, cell, _mixed(found + _U64(0x632BE59BD9B4E019)))
    counts = np.bincount(cell, minlength=len(sums))
    sums, counts = sums.reshape(-1, n2), counts.reshape(-1, n2)
    totals = np.zeros((len(sums), len(subsets)), dtype=np.uint64)
    filled = np.zeros(totals.shape, dtype=bool)
    for k, row in enumerate(subsets):
        for j in np.flatnonzero(row):
            totals[:, k] += sums[:, j]
            filled[:, k] |= counts[:, j] > 0
    place = np.arange(len(sums)) - np.repeat(first[:-1], n1s)  # of a part within its job
    label = (place[:, None] * len(subsets) + np.arange(len(subsets))).astype(np.uint64)
    label += np.repeat(np.array([(band + 1) << 40 for _, band, _ in jobs], dtype=np.uint64), n1s)[:, None]
    out = _mixed(_mixed(totals) + label * _U64(0x9E3779B97F4A7C15))
    out &= _U64((1 << 8 * SIG_BYTES) - 1)  # a byte less to shuffle; two signatures that coincide by chance only cost a comparison
    poor = np.add.reduceat((~filled.all(axis=1)).astype(np.int64), first[:-1]) > slacks
    filled |= np.repeat(poor, n1s)[:, None]
    return [out[a:b][filled[a:b]] for a, b in zip(first, first[1:], strict=False)]


def block_signatures(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Each set's signatures: in its own band and, if a set of the next band can be similar, as the smaller partner there."""
    by_shape: dict = {}
    for k, found in enumerate(sets):
        if not len(found):
            continue
        band, largest, after = _bands(len(found))
        jobs = [(found, band, largest)]
        if 100 * len(found) >= PERCENT * (largest + 1):
            jobs.append((found, band + 1, after))
        for job in jobs:
            by_shape.setdefault(_layout(job[2])[1:3], []).append((k, job))
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for jobs in by_shape.values():
        for (k, _), signed in zip(jobs, _signed([job for _, job in jobs]), strict=True):
            out[k].append(signed)
    none = np.zeros(0, dtype=np.uint64)
    return [np.concatenate(x) if x else none for x in out]


def signatures(found: np.ndarray) -> np.ndarray:
    return block_signatures([found])[0]


def packed_signatures(signed: np.ndarray) -> bytes:
    return signed.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes()


def unpacked_signatures(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SIG_BYTES, 8), dtype=np.uint8)
    out[:, :SIG_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, SIG_BYTES)
    return out.view(np.int64).ravel()


def _bits(n: int, each: int) -> int:
    return 1 << max(6, math.ceil(math.log2(max(1, each * n))))


def block_sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parities of the elements by hash; as many bits as the next power of two to SKETCH_BITS an element (64 at least)."""
    sizes, bits = [len(x) for x in sets], np.array([_bits(len(x), SKETCH_BITS) for x in sets])
    first = np.concatenate([[0], np.cumsum(bits)])
    found = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = (_mixed(found + _U64(7)) & np.repeat((bits - 1).astype(np.uint64), sizes)).astype(np.int64) + np.repeat(first[:-1], sizes)
    parity = (np.bincount(at, minlength=int(first[-1])) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]


def sketch(found: np.ndarray) -> bytes:
    return block_sketches([found])[0]


def short(n: int, sketched: bytes) -> bytes:
    """A sketch folded to one bit an element (up to the next power of two)."""
    bits, length = bits_of(sketched)
    to = _bits(n, 1)
    return _folded(bits, length, to).to_bytes(to // 8, "little")


def bits_of(raw: bytes) -> tuple[int, int]:
    """A sketch as a number, and its length in bits."""
    return int.from_bytes(raw, "little"), 8 * len(raw)


def _folded(bits: int, length: int, to: int) -> int:
    while length > to:
        length //= 2
        bits = (bits >> length) ^ (bits & ((1 << length) - 1))
    return bits


def may_be_similar(n_r: int, sketch_r: tuple[int, int], n_s: int, sketch_s: tuple[int, int]) -> bool:
    """False only for pairs that certainly are not."""
    if 100 * min(n_r, n_s) < PERCENT * max(n_r, n_s):
        return False
    (r, len_r), (s, len_s) = sketch_r, sketch_s
    if len_r != len_s:
        to = min(len_r, len_s)
        r, s = _folded(r, len_r, to), _folded(s, len_s, to)
    return (r ^ s).bit_count() <= most_differences(n_r, n_s)


def similar(r: np.ndarray, s: np.ndarray) -> bool:
    both = len(np.intersect1d(r, s, assume_unique=True))
    return 100 * both >= PERCENT * (len(r) + len(s) - both) and both > 0


def _texts(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for a, b, texts in text_blocks(batch.column("_text")):
            yield ids[a:b], block_shingles(texts)


def _met_within(ids: list[int], signed: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes]]:
    """Of a block's documents: the signatures that each is the first to have, and its (signature, first document) pairs for
    those that several have. What a document does not send itself is thus linked to the one that sends it."""
    sigs = np.concatenate([*signed, np.zeros(0, np.uint64)])
    sizes = [len(x) for x in signed]
    docs = np.repeat(np.array(ids, dtype=np.int64), sizes)
    order = np.argsort(sigs, kind="stable")
    starts = np.ones(len(sigs), dtype=bool)
    starts[1:] = sigs[order][1:] != sigs[order][:-1]
    first, hub, several = np.zeros(len(sigs), dtype=bool), np.zeros(len(sigs), dtype=np.int64), np.zeros(len(sigs), dtype=bool)
    if len(sigs):
        at, group = np.flatnonzero(starts), np.cumsum(starts) - 1
        first[order] = starts
        hub[order] = docs[order][at][group]
        several[order] = (np.diff(np.append(at, len(sigs))) > 1)[group]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    own, met = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        shared = several[a:b]
        own.append(sigs[a:b][first[a:b]])
        met.append(np.stack([sigs[a:b][shared].view(np.int64), hub[a:b][shared]], axis=1).tobytes())
    return own, met


def _profiles(batches):
    """A row for each document. Of a class's documents in a task only the first has signatures; those without doc_id have none."""
    seen: set[bytes] = set()
    for ids, sets in _texts(batches):
        keys, senders = [_key(s) for s in sets], []
        for k, (doc, s, key) in enumerate(zip(ids, sets, keys, strict=True)):
            if doc is not None and len(s) and key not in seen:
                senders.append(k)
                seen.add(key)
        own, met = _met_within([ids[k] for k in senders], block_signatures([sets[k] for k in senders]))
        columns: list[list[bytes | None]] = [[None] * len(ids) for _ in range(DEALS + 1)]
        for k, sigs, pairs in zip(senders, own, met, strict=True):
            columns[0][k] = pairs
            for share in range(DEALS):
                columns[1 + share][k] = packed_signatures(sigs[sigs % _U64(DEALS) == _U64(share)])
        if len(seen) > SEEN_KEYS:
            seen.clear()
        sketches = block_sketches(sets)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()),
                pa.array([short(len(s), x) for s, x in zip(sets, sketches, strict=True)], pa.binary()), *(pa.array(x, pa.binary()) for x in columns),
            ],
            names=["doc_id", "n", "key", "sketch", "short", "met", *SHARES],
        )


def _key(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _packed(batches, width: int):
    """(documents, numbers of packed bytes each, the bytes) in runs of bounded size, from rows (doc_id, packed)."""
    for batch in batches:
        ids, raws, size = [], [], 0
        for doc, raw in zip(*batch.columns, strict=True):
            ids.append(doc.as_py())
            raws.append(raw.as_py())
            size += len(raws[-1])
            if size >= DEAL_BYTES:
                yield np.repeat(np.array(ids, dtype=np.int64), [len(r) // width for r in raws]), b"".join(raws)
                ids, raws, size = [], [], 0
        if ids:
            yield np.repeat(np.array(ids, dtype=np.int64), [len(r) // width for r in raws]), b"".join(raws)


def _firsts(batches):
    """sig, doc_id: a block's first document of each signature."""
    for docs, raw in _packed(batches, SIG_BYTES):
        yield pa.RecordBatch.from_arrays([pa.array(unpacked_signatures(raw)), pa.array(docs)], names=["sig", "doc_id"])


def _met(batches):
    """sig, doc_id, hub: the documents that met another one within their block, beside the first of them."""
    for docs, raw in _packed(batches, 16):
        pairs = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(docs), pa.array(pairs[:, 1].copy())], names=["sig", "doc_id", "hub"])


def _contents(batches):
    for ids, sets in _texts(batches):
        cols = [pa.array(ids, pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "content"])


def _unsketched(batches):
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        keep = [may_be_similar(nr, bits_of(sr), ns, bits_of(ss)) for _, _, nr, sr, ns, ss in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _verified(batches):
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        keep = [similar(np.frombuffer(r, np.uint64), np.frombuffer(s, np.uint64)) for _, _, r, s in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _near(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(bits that differ, i, j) of the rows (n, component, doc, sketch), sorted by n, of different components that the sketches do not rule out."""
    out = []
    if len(rows) < BY_ARRAYS:
        held = [(n, comp, bits_of(sk)) for n, comp, _, sk in rows]
        for i, (n, comp, (bits, length)) in enumerate(held):
            for j in range(i + 1, len(held)):
                n2, comp2, (bits2, length2) = held[j]
                if 100 * n < PERCENT * n2:
                    break
                if comp2 != comp:
                    off = (bits ^ _folded(bits2, length2, length)).bit_count()
                    if off <= most_differences(n, n2):
                        out.append((off, i, j))
        return out
    sizes, comps = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    lengths = np.array([len(r[3]) for r in rows])  # grow with the size, so those of one length are neighbours
    starts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(rows)]
    tables = [np.frombuffer(b"".join(r[3] for r in rows[a:b]), dtype=_U64).reshape(b - a, -1) for a, b in zip(starts, starts[1:], strict=False)]
    for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        own, longer = tables[k], None
        if b < len(rows) and lengths[b] == 2 * lengths[a]:
            half = own.shape[1]
            longer = tables[k + 1][:, :half] ^ tables[k + 1][:, half:]
        for i in range(a, b):
            end = int(np.searchsorted(sizes, sizes[i] * 100 // PERCENT, side="right"))
            for table, low, high in ((own, i + 1, min(end, b)), (longer, b, min(end, starts[k + 2]) if longer is not None else b)):
                if low >= high:
                    continue
                base = a if table is own else b
                others = low + np.flatnonzero(comps[low:high] != comps[i])
                if not len(others):
                    continue
                off = np.bitwise_count(table[others - base] ^ own[i - a]).sum(axis=1, dtype=np.int64)
                near = off <= (sizes[i] + sizes[others]) * (100 - PERCENT) // (100 + PERCENT)
                out += [(o, i, j) for o, j in zip(off[near].tolist(), others[near].tolist(), strict=True)]
    return out


def _across(most: int | None):
    """Pairs (a, b) of different components within a bucket's cell (rows sorted by sig, i, j) that the sketches do not rule out.

    ``most`` 1: as few as would link all components; else the nearest ``most`` of any two components (None: all), and
    ``cut`` where there are more.
    """

    def pairs(rows, out):
        rows.sort(key=lambda r: (r[0], len(r[3])))
        near = sorted(_near(rows))
        up: dict = {}

        def root(x):
            while x in up:
                x = up[x]
            return x

        seen: dict = {}
        for _, i, j in near:
            (_, c, doc, _), (_, c2, doc2, _) = rows[i], rows[j]
            pair = (doc, doc2) if doc < doc2 else (doc2, doc)
            if most == 1:
                c, c2 = root(c), root(c2)
                if c != c2:
                    up[c] = c2
                    out.setdefault(pair, False)
                continue
            two = (c, c2) if c < c2 else (c2, c)
            seen[two] = seen.get(two, 0) + 1
            if most is None or seen[two] <= most:
                out.setdefault(pair, False)
            elif seen[two] == most + 1:
                out[pair] = True

    def batch_of(found):
        keys = sorted(found)
        cols = [pa.array([x[k] for x in keys], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([found[x] for x in keys], pa.bool_())], names=["a", "b", "cut"])

    def run(batches):
        last, rows, found = None, [], {}
        for batch in batches:
            for sig, i, j, comp, doc, n, sk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sig, i, j) != last:
                    pairs(rows, found)
                    last, rows = (sig, i, j), []
                    if len(found) > 100_000:
                        yield batch_of(found)
                        found = {}
                rows.append((n, comp, doc, sk))
        pairs(rows, found)
        yield batch_of(found)

    return run


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written down."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _links(pairs: DataFrame, sides: DataFrame, docs: DataFrame, sketched: bool) -> DataFrame:
    """The pairs (a, b) of representatives that are similar."""
    candidates = None
    if not sketched:
        met = pairs.join(sides.select(F.col("rep").alias("a"), F.col("n").alias("nr"), F.col("short").alias("sr")), "a")
        met = met.join(sides.select(F.col("rep").alias("b"), F.col("n").alias("ns"), F.col("short").alias("ss")), "b")
        pairs = candidates = materialise(met.select("a", "b", "nr", "sr", "ns", "ss").mapInArrow(frugal(_unsketched), "a long, b long").distinct(), "candidates")
    wanted = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    texts = likely(docs, "doc_id", wanted).join(wanted, "doc_id", "left_semi")
    contents = texts.mapInArrow(frugal(_contents), "doc_id long, key binary, content binary").groupBy("doc_id", "key").agg(F.first("content").alias("content"))  # repeated rows
    contents = materialise(contents.drop("key"), "contents")
    met = pairs.join(contents.withColumnRenamed("doc_id", "b").withColumnRenamed("content", "s"), "b")
    met = met.join(contents.withColumnRenamed("doc_id", "a").withColumnRenamed("content", "r"), "a")
    links = materialise(met.select("a", "b", "r", "s").mapInArrow(frugal(_verified), "a long, b long"), "links")
    discard(contents, wanted, candidates)
    _release(docs.sparkSession)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of (a, b) links.

    Each round every node points to its least neighbour, pointers are followed to their roots by doubling, and the
    links are carried over to the roots; a round leaves at most half of the nodes of each unfinished component.
    """
    labels, edges = None, links
    while True:
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        up = materialise(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "up")
        while True:
            over = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = materialise(up.join(over, "to").select("node", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")), "up")
            done = jumped.where("moved").isEmpty()
            up = jumped.drop("moved")
            if done:
                break
        roots = up.select(F.col("node").alias("_n"), F.col("to").alias("_r"))
        if labels is None:
            labels = up.toDF("node", "component")
        else:
            labels = labels.join(roots, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_r", "component").alias("component"))
        labels = materialise(labels, "labels")
        a = edges.join(roots, F.col("a") == F.col("_n")).select(F.col("_r").alias("x"), "b")
        b = a.join(roots, F.col("b") == F.col("_n")).select(F.least("x", "_r").alias("a"), F.greatest("x", "_r").alias("b"))
        edges = materialise(b.where("a != b").distinct(), "edges")
        if edges.isEmpty():
            return labels


def _dealt(documents: DataFrame) -> tuple[DataFrame, ...]:
    """The texts; each row's size; doc_ids with their classes' representatives; each class's profile; links of doc_ids with
    several classes; and the buckets of several documents."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    wide = materialise(docs.mapInArrow(frugal(_profiles), ", ".join(["doc_id long, n long, key binary, sketch binary, short binary, met binary", *(f"{x} binary" for x in SHARES)])), "signed")
    rows = materialise(wide.select("doc_id", "n", "key"), "profiles")
    named = rows.where("doc_id is not null and n > 0").select("doc_id", "key")
    classes = materialise(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")  # written, so that a class's rows may be split in the joins
    reps = materialise(named.join(classes, "key").groupBy("doc_id", "rep").agg(F.count("*").alias("_n")).drop("_n"), "reps")
    sides = wide.where("n > 0").select(F.col("doc_id").alias("rep"), "key", "n", "sketch", "short").join(classes, ["rep", "key"])
    sides = materialise(sides.groupBy("rep", "key", "n").agg(F.first("sketch").alias("sketch"), F.first("short").alias("short")), "sides")
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("doc_id", "a")
    own = materialise(reps.join(several, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")).distinct(), "own")

    signed = wide.where("sigs0 is not null")
    buckets = materialise(signed.select("doc_id", "met").mapInArrow(frugal(_met), "sig long, doc_id long, hub long"), "buckets")
    tables, of_sig = [buckets], Window.partitionBy("sig")
    for share in SHARES:
        firsts = signed.select("doc_id", share).mapInArrow(frugal(_firsts), "sig long, doc_id long")
        shared = firsts.withColumn("hub", F.min("doc_id").over(of_sig)).withColumn("top", F.max("doc_id").over(of_sig)).where("hub != top").drop("top")
        tables.append(found := materialise(shared, "buckets"))
        buckets = buckets.union(found)
        del firsts, shared, found
        _release(spark)
    discard(wide, classes)
    return docs, rows, reps, sides, own, buckets, tables


def _stars(buckets: DataFrame) -> DataFrame:
    """hub, doc_id: each document with the first of each of its buckets, once."""
    return materialise(buckets.where("doc_id != hub").select("hub", "doc_id").distinct(), "stars")


def _hub_pairs(stars: DataFrame, reps: DataFrame) -> DataFrame:
    """The stars as pairs (a, b) of representatives."""
    pairs = stars.join(reps.withColumnRenamed("rep", "y"), "doc_id").join(reps.select(F.col("doc_id").alias("hub"), F.col("rep").alias("x")), "hub")
    return materialise(pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")


def _cells(buckets: DataFrame, stars: DataFrame, place: DataFrame, block: int) -> DataFrame:
    """sig, i, j, rep, component: the rows (sig, doc_id, hub) of buckets of several components, by (doc_id, rep, component).

    A bucket has several components if a document is not in its hub's, and there are far fewer such (hub, doc_id) than
    rows. A bucket of at most ``block`` rows is one cell. In a larger one the rows of its commonest component are dealt
    out in blocks, and so are the others; a cell for each two blocks of others, and for each block of others and one of
    the former.
    """
    own = place.groupBy("doc_id").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))  # one, but for repeated doc_ids where each class is its own
    of_hub = own.select(F.col("doc_id").alias("hub"), F.col("lo").alias("hub_lo"), F.col("hi").alias("hub_hi"))
    apart = stars.join(own, "doc_id").join(of_hub, "hub").where("lo != hub_lo or hi != hub_hi or lo != hi")
    key = F.xxhash64("hub", "doc_id").alias("star")
    apart = materialise(apart.select(key).distinct(), "apart")
    sigs = likely(buckets.select("sig", key), "star", apart).join(apart, "star", "left_semi")
    sigs = materialise(sigs.select("sig").distinct(), "mixed")
    rows = likely(buckets, "sig", sigs).join(sigs, "sig", "left_semi").join(place, "doc_id").groupBy("sig", "rep", "component").agg(F.count("*").alias("_n"))
    rows = materialise(rows.drop("_n"), "members")
    counts = rows.groupBy("sig").agg(F.count("*").alias("k")).where("k > 2")  # of two rows, each other's first, nothing is left to compare
    counts = materialise(counts, "counts")
    rows = rows.join(counts, "sig")
    huge = counts.where(F.col("k") > block).select("sig")
    zero = F.lit(0).alias("i"), F.lit(0).alias("j")
    if huge.isEmpty():
        return rows.select("sig", *zero, "rep", "component")
    inside = rows.join(huge, "sig", "left_semi")
    sizes = inside.groupBy("sig", "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy("sig").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("k"))
    most = materialise(most.select("sig", F.col("m.component").alias("_most"), F.ceil((F.col("k") - F.col("m.n")) / block).cast("int").alias("_s"), F.ceil(F.col("m.n") / block).cast("int").alias("_t")), "most")
    common = F.col("component") == F.col("_most")
    here = F.pmod(F.xxhash64("rep"), F.when(common, F.col("_t")).otherwise(F.col("_s"))).cast("int")
    others = F.sequence(F.lit(0), F.col("_s") - 1)
    of_most = F.transform(others, lambda i: F.struct(i.alias("i"), (F.col("_s") + F.col("_own")).alias("j")))
    of_rest = F.concat(
        F.transform(others, lambda i: F.struct(F.least(i, F.col("_own")).alias("i"), F.greatest(i, F.col("_own")).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda j: F.struct(F.col("_own").alias("i"), (F.col("_s") + j).alias("j"))),
    )
    dealt = inside.join(most.where("_s > 0"), "sig").withColumn("_own", here).withColumn("_c", F.explode(F.when(common, of_most).otherwise(of_rest)))
    return rows.join(huge, "sig", "left_anti").select("sig", *zero, "rep", "component").union(dealt.select("sig", "_c.i", "_c.j", "rep", "component"))


def _compared(cells: DataFrame, sides: DataFrame, most: int | None) -> DataFrame:
    """a, b, cut: what ``_across`` finds among the cells' rows."""
    known = cells.join(sides.select("rep", "n", "sketch"), "rep").select("sig", "i", "j", "component", "rep", "n", "sketch")
    dealt = known.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(frugal(_across(most)), "a long, b long, cut boolean").groupBy("a", "b").agg(F.bool_or("cut").alias("cut"))


def similar_pairs(documents: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The join: all similar pairs (a, b), verified, of representatives of equal sets; and doc_id, rep: each doc_id's representatives.

    Unlike ``near_duplicates``, pairs within a component are compared too, so the result can grow with the square of a group.
    """
    docs, _, reps, sides, _, buckets, _ = _dealt(documents)
    stars = _stars(buckets)
    pairs = _hub_pairs(stars, reps)
    place = reps.withColumn("component", F.col("rep"))
    met = _compared(_cells(buckets, stars, place, block), sides, None).select("a", "b").union(pairs).distinct()
    return _links(materialise(met, "met"), sides, docs, sketched=False), reps


def near_duplicates(documents: DataFrame, block: int = BLOCK, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents``."""
    spark = documents.sparkSession
    docs, rows, reps, sides, own, buckets, tables = _dealt(documents)
    stars = _stars(buckets)
    pairs = _hub_pairs(stars, reps)
    links = own.union(_links(pairs, sides, docs, sketched=False))
    labels = components(links)
    _release(spark)

    # Buckets in which several components met: their documents are compared across these. A share of the buckets goes
    # first; what it links leaves few buckets for the passes over all of them, which make the result exact.
    share, most = FIRST_SHARE, 1
    while True:
        place = reps.join(labels, reps["rep"] == labels["node"], "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component"))
        part = buckets.where(F.pmod("sig", F.lit(share)) == 0)
        place = materialise(place, "places")
        across = _compared(_cells(part, stars, place, block), sides, most).join(pairs, ["a", "b"], "left_anti")
        across = materialise(across, "across")
        discard(place)
        _release(spark)
        if not across.isEmpty():
            links = links.union(_links(across.select("a", "b"), sides, docs, sketched=True))
            labels = components(links)
            pairs = pairs.union(across.select("a", "b"))
            _release(spark)
        if share == FIRST_SHARE:
            share, most = 1, most_pairs
            continue
        open_a = across.where("cut").join(labels.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left")
        open_ab = open_a.join(labels.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
        if open_ab.where("coalesce(_a, a) != coalesce(_b, b)").isEmpty():
            break
        most *= most_pairs
    discard(*tables)
    # equal for all classes of a doc_id, since ``own`` links them
    place = reps.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = place.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "rep").alias("_c"))
    return rows.join(out, F.col("doc_id") == F.col("_d"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose component has a smaller doc_id; rows without doc_id stay."""
    (gone,) = free_names(docs.columns, ["_gone"])
    dropped = near_duplicates(docs).where("component_id != doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
