"""Personal data: patterns, and information-theoretic sanitisation of what surrounds them; DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns, minus those that fail their rule. The values
they hold are the protected entities. A word of a document that holds an entity discloses it as far as it lets a reader
infer it: PMI(entity; word) / IC(entity), with document frequencies over the whole texts of the whole corpus; 1 would
be certainty. P(entity | word), b of w documents, is discounted to b/w * b/(b + ``DISCOUNT``), as pointwise information is for
small counts, so nine of ten tell more than one of one. Every occurrence, in every document and outside base spans, of a word whose disclosure of
some entity reaches ``GENERALISE_AT`` is a span of kind ``term``: generalised to a class, or removed from ``REMOVE_AT`` on. What
has been seen with an entity in one document alone is generalised at most (``LONE``).

The patterns are the contract's, written so that Java neither recurses nor starts anew within a run of characters:
possessive groups, and a start only where a run starts or the last match ended; both leave the matches the same.

Null texts are empty; repeated rows get the same spans each; an empty table gives an empty result; other columns are
ignored. Ties cannot occur: a span's terms are joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE, discard, load, materialise, text_or_empty

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DISCOUNT = 1.0
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
#: The most that a word discloses of an entity that it has been seen with in one document.
LONE = 0.9
#: Prefix sums go block by block: appending copies a block's numbers and, of the blocks before, the references.
BLOCK = 256
#: So many of the words that are too frequent to disclose anything are set aside before words are dealt out.
FREQUENT = 1 << 15
#: Texts are cut, behind a word, into chunks of about so many code points, so that placing a word reads one chunk.
CHUNK = 1000
#: Least and most 64-bit masks by which words that are surely not flagged are left out before the rest is dealt out.
MASKS = (1 << 14, 1 << 20)

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _ends(lengths: Column) -> Column:
    """Running sums of an array of long."""

    def one(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"] + n)).alias("all"))

    def block(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(lengths, k, BLOCK), F.struct(acc["at"].alias("at"), F.array().cast("array<bigint>").alias("all")), one)
        return F.struct(own["at"].alias("at"), F.concat(acc["all"], F.array(own["all"])).alias("all"))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(BLOCK))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("all"))
    return F.aggregate(firsts, start, block, lambda acc: F.flatten(acc["all"]))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches with code point positions: the pieces between the matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, k: (F.char_length(F.get(between, k)) + F.char_length(m)).cast("bigint"))
    ends = _ends(steps)
    return F.transform(found, lambda m, k: F.struct(F.lit(kind).alias("kind"), (F.get(ends, k) - F.char_length(m)).alias("start"), F.get(ends, k).alias("end"), m.alias("value")))


def _luhn(digits: Column) -> Column:
    doubled = F.array(*(F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    n = F.char_length(digits)

    def digit(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, F.get(doubled, d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), digit) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(13, 19) & F.when(F.char_length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of all kinds, in the kinds' order and by start."""
    none = F.array().cast(_SPAN)
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.contains(text, F.lit("."))}

    def valid(kind: str, pattern: str) -> Column:
        return F.filter(spans(text, kind, pattern), lambda s: _holds(kind, s["value"]))

    return F.concat(*(F.when(needs.get(k, F.lit(True)), valid(k, p)).otherwise(none).cast(_SPAN) for k, p in PATTERNS.items()))


def _entity(span: Column) -> Column:
    """What is protected: the address or number itself, however it is written."""
    return F.xxhash64(span["kind"], F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def _words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), f"[{SPACE}]+")), lambda w: w != "")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosure(both: Column, with_word: Column, with_entity: Column, n_docs: int) -> Column:
    """PMI / IC of an entity and a word that are together in ``both`` documents."""
    n = F.lit(float(max(n_docs, 2)))
    rate = F.least(with_entity, n - 1) / n
    given = both / with_word * both / (both + DISCOUNT)
    told = F.ln(given / rate) / -F.ln(rate)
    return F.when(both > 1, told).otherwise(F.least(told, F.lit(LONE)))


def _most(with_entity: Column, n_docs: int) -> Column:
    """No word of more documents than this discloses an entity of ``with_entity`` documents (``disclosure`` solved for with_word)."""
    n = F.lit(float(max(n_docs, 2)))
    rate = F.least(with_entity, n - 1) / n
    return with_entity * with_entity / (with_entity + DISCOUNT) / F.pow(rate, 1 - GENERALISE_AT) * (1 + 1e-9)


def disclosing(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """word, disclosure (the most of any entity) for words at or above ``GENERALISE_AT``."""
    n_docs = kept.count()
    based = kept.where(F.size("base") > 0)
    held = based.select("_row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    entities = materialise(held.groupBy("entity").agg(F.count("*").alias("with_entity")).withColumn("_most", _most(F.col("with_entity"), n_docs)), "entities")
    most = entities.agg(F.max("_most")).first()[0] or 0.0
    # counted before any join: a frequent word sends one row a task
    every = materialise(rows.select(F.explode(_words(F.col("_text"))).alias("word")).groupBy("word").agg(F.count("*").alias("with_word")), "words")
    frequent = every.where(F.col("with_word") > most).orderBy(F.col("with_word").desc(), "word").limit(FREQUENT).select("word")
    own = based.groupBy("_row").agg(F.count("*").alias("times"), F.first("_words").alias("_words"))  # repeated rows
    own = own.select("_row", "times", F.explode("_words").alias("word")).join(F.broadcast(frequent), "word", "left_anti")
    rare = own.join(every.where(F.col("with_word") <= most), "word")
    holders = held.distinct().join(entities, "entity")
    # a word of one document tells of each entity there what its count alone says, so it meets the most telling one only
    score = disclosure(F.lit(1), F.lit(1), F.col("with_entity"), n_docs)
    best = holders.where(F.col("_most") >= 1).groupBy("_row").agg(F.max(score).alias("disclosure"))
    single = rare.where("with_word = 1").join(best, "_row").select("word", "disclosure")
    pairs = rare.where("with_word > 1").join(holders, "_row").where(F.col("with_word") <= F.col("_most"))
    pairs = pairs.groupBy("entity", "word", "with_word", "with_entity").agg(F.sum("times").alias("both"))
    told = pairs.select("word", disclosure(F.col("both"), F.col("with_word"), F.col("with_entity"), n_docs).alias("disclosure")).unionByName(single)
    out = materialise(told.where(F.col("disclosure") >= GENERALISE_AT).groupBy("word").agg(F.max("disclosure").alias("disclosure")), "disclosing")
    discard(entities, every)
    return out


def _places(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """_row, start, end, disclosure of every occurrence of a flagged word."""
    chunks = F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{CHUNK}}}+[^{SPACE}]*+"), F.lit(0))
    ends = _ends(F.transform(chunks, lambda c: F.char_length(c).cast("bigint")))
    cut = rows.select("_row", F.explode(F.arrays_zip(chunks.alias("chunk"), ends.alias("end"))).alias("_c")).select("_row", "_c.chunk", "_c.end")
    pieces = cut.select("_row", "chunk", "end", F.posexplode(F.split("chunk", f"[{SPACE}]", -1)).alias("_k", "_piece")).withColumn("word", F.lower("_piece"))
    slots = min(max(MASKS[0], flagged.count() // 4), MASKS[1])
    hashed = F.xxhash64("word")
    slot = F.pmod(hashed, F.lit(slots))
    bits = [F.shiftrightunsigned(hashed, n).bitwiseAND(63).cast("int") for n in (40, 50)]
    mask = F.bit_or(F.expr("shiftleft(1L, _one)").bitwiseOR(F.expr("shiftleft(1L, _two)")))
    masks = flagged.select(slot.alias("_slot"), bits[0].alias("_one"), bits[1].alias("_two")).groupBy("_slot").agg(mask.alias("_mask"))
    likely = pieces.where("_piece != ''").withColumn("_slot", slot).join(F.broadcast(masks), "_slot")
    likely = likely.where((F.getbit("_mask", bits[0]) == 1) & (F.getbit("_mask", bits[1]) == 1))
    spaced = F.translate("chunk", "\t\n\x0b\x0c\r", " " * 5)
    end = F.col("end") - F.char_length("chunk") + F.char_length(F.call_function("substring_index", spaced, F.lit(" "), F.col("_k") + 1))
    found = likely.select("_row", "word", (end - F.char_length("_piece")).alias("start"), end.alias("end"))
    return found.join(flagged, "word").select("_row", "start", "end", "disclosure")


def _row() -> Column:
    """What tells rows of another id or text apart: two hashes, since one of 64 bits repeats among 10^10 rows."""
    return F.struct(F.xxhash64("doc_id", "_text").alias("a"), F.xxhash64(F.lit("row"), "_text", "doc_id").alias("b"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, _row (hashes of id and text), base and terms: arrays of spans; terms with their disclosure."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")).withColumn("_row", _row())
    based = rows.withColumn("base", base_spans(F.col("_text")))
    kept = materialise(based.select("doc_id", "_row", "base", F.when(F.size("base") > 0, _words(F.col("_text"))).alias("_words")), "pii")
    found = _places(rows, disclosing(kept, rows))
    terms = found.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms"))
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return kept.drop("_words").join(terms, "_row", "left").withColumn("terms", apart)


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the text with base spans named by their kind, and disclosing terms generalised or removed."""
    found = find_personal_data(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")).withColumn("_row", _row())
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("to"))),
        F.coalesce(F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= REMOVE_AT, "").otherwise("[TERM]").alias("to"))), F.array().cast("array<struct<start:bigint,end:bigint,to:string>>")),
    )

    def cut(acc: Column, m: Column) -> Column:
        past = m["start"] < acc["at"]  # overlaps what is already replaced
        kept = F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int"))
        return F.when(past, F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(m["end"].alias("at"), F.concat(acc["out"], F.array(kept, m["to"])).alias("out"))
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.sort_array("_marks"), start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), F.char_length("_text"))))
    one = found.dropDuplicates(["_row"]).select("_row", marks.alias("_marks"))
    return texts.join(one, "_row").select("doc_id", F.when(F.size("_marks") == 0, F.col("_text")).otherwise(done).alias("text"))


def op3_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load(spark, sf_dir, "documents"))
    base = _joined(F.col("base"))
    terms = F.coalesce(F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string"))), ","), F.lit(""))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in PATTERNS]
    both = F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), both.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))
