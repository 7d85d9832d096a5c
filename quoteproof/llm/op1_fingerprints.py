"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are the lower-cased words of the whole text, weighted by their counts. For each of ``SAMPLES`` hash functions
and each term, hashes give r and c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the term's draw is
ln a = ln c - r (t - b + 1), and the least draw's (term, t) is the sample. Two texts agree in a sample with a
probability equal to the generalised Jaccard similarity of their weighted terms, sum of minima over sum of maxima.

A text's terms are counted within its row, so that no task holds more than one row a term at a time, and each row's
draws are reduced as they come.

Null texts are empty. A text without words has the empty fingerprint, which equals itself and no other. Equal texts
(also ties and repeated rows) have equal fingerprints; every row is kept and rows are told apart by their place in the
order (doc_id descending, then the text's hash descending), in which a null doc_id is last. An empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import SPACE, load, text_or_empty

SAMPLES = 32
#: Neighbouring doc_ids share a bucket of about so many bytes of text; at most so many buckets, since their first rows'
#: ids (and nothing else) are broadcast.
BUCKET_BYTES = 1 << 20
MOST_BUCKETS = 1 << 16
#: Quantiles of doc_id between which the buckets are spread evenly.
KNOTS = 64

_U21, _U32 = float(1 << 21), float(1 << 32)


def _draw(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th draw of a term: 31 bits of ln a above 32 bits that name (term, t)."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    u1 = (F.shiftrightunsigned(one, 43) + 0.5) / _U21
    u2 = (F.shiftrightunsigned(one, 22).bitwiseAND(0x1FFFFF) + 0.5) / _U21
    b = one.bitwiseAND(0x3FFFFF) / float(1 << 22)
    u3 = (F.shiftrightunsigned(two, 32) + 0.5) / _U32
    u4 = (two.bitwiseAND(0xFFFFFFFF) + 0.5) / _U32
    r, c = -F.ln(u1 * u2), -F.ln(u3 * u4)
    t = F.floor(log_weight / r + b)
    log_a = F.ln(c) - r * (t - b + 1.0)
    name = one.bitwiseXOR(t * 2654435761).bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(((log_a + 128.0) * float(1 << 23)).cast("long"), 32).bitwiseOR(name)


def _sorted_terms(text: Column) -> Column:
    """The hashes of all words, sorted."""
    words = F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _starts(terms: Column) -> Column:
    """Where each distinct term of a sorted array begins, and the array's end."""
    n = F.size(terms)
    changes = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(terms, i) != F.get(terms, i - 1))
    return F.when(n > 1, F.concat(F.array(F.lit(0)), changes, F.array(n))).when(n == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array().cast("array<int>"))


def _weighted(texts: DataFrame, versions: list[str]) -> DataFrame:
    """``texts`` with _v, _term, _ln instead of the versions: a row for each distinct term of each version (none: nulls)."""
    rest = [c for c in texts.columns if c not in versions]
    sorted_ = texts.select(*rest, *(_sorted_terms(F.col(v)).alias(f"_t{k}") for k, v in enumerate(versions)))
    cut = sorted_.select(*rest, *(c for k in range(len(versions)) for c in (F.col(f"_t{k}"), _starts(F.col(f"_t{k}")).alias(f"_a{k}"))))

    def counted(k: int) -> Column:
        terms, starts = F.col(f"_t{k}"), F.col(f"_a{k}")
        ends = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
        heads = F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0)))
        return F.zip_with(heads, ends, lambda a, b: F.struct(F.lit(k).alias("v"), F.get(terms, a).alias("term"), (b - a).alias("n")))

    found = cut.select(*rest, F.explode_outer(F.concat(*(counted(k) for k in range(len(versions))))).alias("_x"))
    return found.select(*rest, F.col("_x.v").alias("_v"), F.col("_x.term").alias("_term"), F.ln(F.col("_x.n")).alias("_ln"))


def version_fingerprints(texts: DataFrame, versions: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """``texts`` with a fingerprint (8 hex digits a sample; empty without words) in place of each text column of ``versions``
    (text column: fingerprint column). The other columns name a row; equal rows become one."""
    rest = [c for c in texts.columns if c not in versions]
    terms = _weighted(texts, list(versions))
    least = terms.groupBy(*rest, "_v").agg(*(F.min(_draw(F.col("_term"), F.col("_ln"), k)).alias(f"_s{k}") for k in range(samples)))
    rows = least.groupBy(*rest).agg(*(F.max(F.when(F.col("_v") == v, F.col(f"_s{k}"))).alias(f"_s{v}_{k}") for v in range(len(versions)) for k in range(samples)))

    def joined(v: int) -> Column:
        return F.concat(*(F.coalesce(F.lpad(F.lower(F.hex(F.col(f"_s{v}_{k}").bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit("")) for k in range(samples)))

    return rows.select(*rest, *(joined(v).alias(name) for v, name in enumerate(versions.values())))


def fingerprints(texts: DataFrame, key: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``key`` and fingerprint, one row for each key."""
    return version_fingerprints(texts.select(*key, text), {text: "fingerprint"}, samples)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    places = F.sequence(F.lit(1), F.lit(8 * samples - 7), F.lit(8))
    same = F.size(F.filter(places, lambda k: F.substring(a, k, F.lit(8)) == F.substring(b, k, F.lit(8))))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / float(samples))


def standard_error(similarity: float, samples: int = SAMPLES) -> float:
    """Of the likeness of a single pair: samples are independent, so agreements are binomial."""
    return (similarity * (1 - similarity) / samples) ** 0.5


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with _h, the text's hash, and _bucket: neighbours in the order share one, later rows have lower ones.

    Buckets lie evenly between quantiles of doc_id. The null doc_id, and one that several quantiles fall on, are cut up
    by the hash, which is next in the order.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = max(1, min(MOST_BUCKETS, size // BUCKET_BYTES) // KNOTS)
    found = [max(-(2**63), min(2**63 - 1, int(x))) for x in rows.approxQuantile("doc_id", [k / KNOTS for k in range(KNOTS + 1)], 1 / (4 * KNOTS))]
    knots = sorted(set(found))
    doc, h = F.col("doc_id"), F.col("_h")

    def by_hash(buckets: int) -> Column:
        return F.floor((F.shiftright(h, 33) + (1 << 30)) / float(1 << 31) * buckets).cast("int")

    out, base = by_hash(each), each  # null doc_ids are last in the order
    for k, low in enumerate(knots):
        hot = each * (found.count(low) - 1)
        high = knots[k + 1] if k + 1 < len(knots) else low + 1.0
        inside = F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor((doc.cast("double") - float(low)) / max(float(high) - float(low), 1.0) * each))).cast("int")
        own = F.when(doc == low, base + by_hash(hot)).otherwise(base + hot + inside) if hot else base + inside
        out = F.when(doc.isNotNull() if k == 0 else doc >= low, F.when(doc < low, base).otherwise(own) if k == 0 else own).otherwise(out)
        base += hot + each
    return rows.withColumn("_h", F.xxhash64("text")).withColumn("_bucket", out.cast("int"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """_bucket, _nth, _guest, doc_id, text, edited: each text beside its edited text (null for guests).

    A bucket's last row has its next document as a guest, so texts are dealt out once, by bucket. Only the guests'
    ids and hashes, one for each bucket, are broadcast: at most some ``MOST_BUCKETS`` rows.
    """
    rows = _bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    firsts = rows.groupBy("_bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.col("doc_id").isNotNull().alias("known"), "doc_id", "_h")).alias("f"))
    by_id = Window.orderBy(F.col("_bucket").desc())
    hosts = firsts.withColumn("_host", F.coalesce(F.lag("_bucket").over(by_id), F.min("_bucket").over(Window.partitionBy())))
    hosts = hosts.select(F.col("_bucket").alias("_b"), F.col("f.doc_id").alias("_first"), F.col("f._h").alias("_fh"), "_host")
    of_host = (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_h") == F.col("_fh"))
    guests = rows.join(F.broadcast(hosts), of_host).dropDuplicates(["_bucket"])  # of equal rows one
    guests = guests.select(F.col("_host").alias("_bucket"), F.lit(True).alias("_guest"), "doc_id", "_h", "text")
    placed = rows.select("_bucket", F.lit(False).alias("_guest"), "doc_id", "_h", "text").union(guests)
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_h").desc())
    dealt = placed.withColumn("_next", F.lead("text").over(order)).withColumn("_nth", F.row_number().over(order))
    n = F.char_length("text")
    swapped = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - swapped), F.substring("_next", F.lit(1), swapped))
    return dealt.select("_bucket", "_nth", "_guest", "doc_id", "text", F.when(~F.col("_guest"), edited).alias("edited"))


def op1_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_documents(load(spark, sf_dir, "documents"))
    texts = pairs.select(
        "_bucket", "_nth", "_guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("_sha"),
        "text", F.coalesce("edited", F.lit("")).alias("edited"),
    )
    found = version_fingerprints(texts, {"text": "fingerprint", "edited": "edited_fingerprint"})
    after = F.lead("fingerprint").over(Window.partitionBy("_bucket").orderBy("_nth"))
    return found.withColumn("_next", after).where("not _guest").select(
        "doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
