"""Review: where a value comes from, how it is shown, and what a correction may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteproof.functions import values
from quoteproof.schema import HEADER_KEYS, ITEM_KEYS, LIMITS

# Names shown for places and units.
UNIT_SHOWN = {"pcs": "Stk."}
REASON_CHARS = 1000


def display_value(field_key: Column, value: Column) -> Column:
    """Units read as people write them; every other value as it is."""
    shown = F.create_map(*(F.lit(x) for pair in UNIT_SHOWN.items() for x in pair))
    return F.when(field_key == "unit", F.coalesce(F.try_element_at(shown, value), value)).otherwise(value)


def mark_quote(text: Column, quote: Column) -> Column:
    """array<struct<text, mark>>: the quote's first place in the text is marked, without regard to case only where lower
    case has as many characters; the whole text where it is not found."""
    low, low_quote = F.lower(text), F.lower(quote)
    comparable = (F.char_length(low) == F.char_length(text)) & (F.char_length(low_quote) == F.char_length(quote))
    exact = F.instr(text, quote)
    at = F.when(quote == "", 0).when(exact > 0, exact).when(comparable, F.instr(low, low_quote)).otherwise(0)
    n = F.char_length(quote)

    def part(shown: Column, mark: bool) -> Column:
        return F.struct(shown.alias("text"), F.lit(mark).alias("mark"))

    cut = F.array(part(F.substring(text, F.lit(1), at - 1), False), part(F.substring(text, at, n), True), part(F.substring(text, at + n, F.char_length(text)), False))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.filter(cut, lambda p: p["text"] != "")).otherwise(F.array(part(text, True)))


# --- places

#: What a reader's locators hold, read from JSON; nested attachments are unwrapped level by level.
PLACE = "kind string, part string, line int, header string, sheet string, row int, cellRange string, cell string, paragraph int, `table` int, page int, ocr boolean"
MOST_LEVELS = 4


def unwrapped(locator: Column) -> Column:
    """struct(inner, names, path): a locator's innermost place, and the attachments' names and positions, outermost first.

    The levels are folded in turn, so that each is read once; as one expression of all levels it would be read again for each
    place that names it.
    """
    said = F.get_json_object

    def opened(acc: Column, inner: Column) -> Column:
        def around(index: Column) -> Column:
            name = F.nullif(said(acc["inner"], "$.attachment.name"), F.lit(""))
            shown = F.coalesce(name, F.concat(F.lit("Anhang "), (F.coalesce(index.try_cast("int"), F.lit(0)) + 1).cast("string")))
            names, path = F.concat(acc["names"], F.array(shown)), F.concat(acc["path"], F.array(F.coalesce(index, F.lit("?"))))
            return F.struct(inner.alias("inner"), names.alias("names"), path.alias("path"))

        return F.when(inner.isNotNull(), values.let(said(acc["inner"], "$.attachment.index"), around)).otherwise(acc)

    def level(acc: Column, _: Column) -> Column:
        text = acc["inner"]
        may = F.contains(text, F.lit("msg")) | F.contains(text, F.lit("\\"))  # or written with escapes
        wrapped = may & (said(text, "$.kind") == "msg") & (said(text, "$.part") == "attachment")
        return values.let(F.when(wrapped, said(text, "$.inner")), lambda inner: opened(acc, inner))

    none = F.array().cast("array<string>")
    start = F.struct(locator.alias("inner"), none.alias("names"), none.alias("path"))
    done = lambda acc: F.struct(acc["inner"].alias("inner"), acc["names"].alias("names"), F.array_join(acc["path"], "/").alias("path"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LEVELS)), start, level, done)


def _is_mail(place: Column) -> Column:
    return place["kind"].isin("email", "msg")


def label(place: Column) -> Column:
    """What a line of the source view is called, by its place (a struct of ``PLACE``)."""

    def said(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))

    in_table = (place["part"] == "table_cell") | (place["part"].isNull() & place["table"].isNotNull())
    return (
        F.when(_is_mail(place), F.when(place["part"] == "header", said("Kopf: ", place["header"])).otherwise(said("Zeile ", place["line"])))
        .when(place["kind"] == "xlsx", said(place["sheet"], "!", F.coalesce(place["cellRange"], place["cell"])))
        .when(place["kind"] == "docx", F.when(in_table, said("Tabelle ", place["table"], ", Zeile ", place["row"], ", Zelle ", place["cell"])).otherwise(said("Absatz ", place["paragraph"])))
        .otherwise(said("Seite ", place["page"]))
    )


def heading(place: Column, names: Column) -> Column:
    base = (
        F.when(place["kind"] == "pdf", F.concat(F.lit("Seite "), place["page"].cast("string"), F.when(F.coalesce(place["ocr"], F.lit(False)), " (Texterkennung)").otherwise("")))
        .when(place["kind"] == "xlsx", F.concat(F.lit("Tabellenblatt "), place["sheet"])).when(place["kind"] == "docx", "Word-Dokument").otherwise("E-Mail")
    )
    return F.array_join(F.concat(F.transform(names, lambda n: F.concat(F.lit("Anhang "), n)), F.array(base)), " – ")


def context_key(place: Column, path: Column) -> Column:
    """Segments shown together: a page, a sheet, or a whole mail or Word file, within one attachment."""
    own = F.when(_is_mail(place), "mail").otherwise(F.concat_ws(":", place["kind"], F.when(place["kind"] == "pdf", place["page"].cast("string")).when(place["kind"] == "xlsx", place["sheet"])))
    return F.concat_ws("|", F.coalesce(path, F.lit("")), own)


def placed(segments: DataFrame) -> DataFrame:
    """``segments`` (with a JSON locator) and their place, names and context."""
    opened = segments.withColumn("_u", unwrapped(F.col("locator"))).withColumn("place", F.from_json("_u.inner", PLACE))
    return opened.withColumn("names", F.col("_u.names")).withColumn("context", context_key(F.col("place"), F.col("_u.path"))).drop("_u")


def source_view(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """For each (evidence_id, document_id, segment_id, quote) the lines around its segment: position, segment_id, label,
    cited, parts, and the view's kind, heading and ocr. An equi-join on the context; unknown segments give no line."""
    known = placed(segments)
    cited = placed(evidence.join(segments.select("document_id", "segment_id", "locator"), ["document_id", "segment_id"]))
    kind = F.when(F.col("place.kind").isin("pdf", "xlsx", "docx"), F.col("place.kind")).otherwise("email")
    views = cited.select(
        "evidence_id", "document_id", F.col("segment_id").alias("_cited"), "quote", "context", kind.alias("kind"),
        heading(F.col("place"), F.col("names")).alias("heading"), F.coalesce("place.ocr", F.lit(False)).alias("ocr"),
    )
    lines = views.join(known.select("document_id", "context", "segment_id", "position", "text", "place"), ["document_id", "context"])
    is_cited = F.col("segment_id") == F.col("_cited")
    parts = F.when(is_cited, mark_quote(F.col("text"), F.col("quote"))).otherwise(F.array(F.struct(F.col("text").alias("text"), F.lit(False).alias("mark"))))
    return lines.select("evidence_id", "kind", "heading", "ocr", "position", "segment_id", label(F.col("place")).alias("label"), is_cited.alias("cited"), parts.alias("parts"))


def marked_contexts(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Every line of a context that some evidence cites, once, with ``marks``: (evidence_id, parts) of each evidence that cites the
    line. The same lines as ``source_view`` gives for each evidence, but as many rows as lines, however many cite a context."""
    known = placed(segments)
    cited = evidence.join(segments.select("document_id", "segment_id", "locator", "text"), ["document_id", "segment_id"])
    contexts = placed(cited.select("document_id", "segment_id", "locator")).select("document_id", "context").distinct()
    marks = cited.groupBy("document_id", "segment_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", mark_quote(F.col("text"), F.col("quote")).alias("parts")))).alias("marks"))
    shown = known.join(contexts, ["document_id", "context"], "left_semi")
    kind = F.when(F.col("place.kind").isin("pdf", "xlsx", "docx"), F.col("place.kind")).otherwise("email")
    return shown.join(marks, ["document_id", "segment_id"], "left").select(
        "document_id", "context", kind.alias("kind"), heading(F.col("place"), F.col("names")).alias("heading"), F.coalesce("place.ocr", F.lit(False)).alias("ocr"), "position",
        "segment_id", "text", label(F.col("place")).alias("label"), "marks",
    )


# --- corrections


def correction_value(field_key: Column, entered: Column) -> Column:
    """What is stored: trimmed, cut, empty as null, a unit in its canonical form if it is one."""
    cut = F.nullif(F.substring(values.stripped(entered), 1, LIMITS["field"]), F.lit(""))
    return F.when(field_key == "unit", F.coalesce(values.unit(cut), cut)).otherwise(cut)


def correction_refusal(field_key: Column, item_index: Column) -> Column:
    """unknown_field, or null: header fields have no index, item fields one from 0 on."""
    known = F.when(item_index.isNull(), field_key.isin(*HEADER_KEYS)).otherwise(field_key.isin(*ITEM_KEYS) & (item_index >= 0))
    return F.when(~F.coalesce(known, F.lit(False)), "unknown_field")


def reason_value(reason: Column) -> Column:
    """The trimmed reason; null where it is empty or too long and so refused."""
    trimmed = values.stripped(reason)
    return F.when(F.char_length(trimmed).between(1, REASON_CHARS), trimmed)


def open_items(fields: DataFrame, key: str = "request_id") -> DataFrame:
    """key, n: header and item fields that still need attention."""
    return fields.groupBy(key).agg(F.count_if(F.col("status").isin("uncertain", "unverified") & ~F.col("corrected")).alias("n"))


def header_and_items(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    return fields.where("item_index is null"), fields.where("item_index is not null")
