"""Messages with attachments, expanded under one shared budget: a failing attachment is a report row, never an error.

A message is what a reader of an outer format gives: its own segments and its attachments, each with bytes, or another
message, or neither (attached by reference). ``expand`` reads one document; ``reports`` applies the same limits to a table of all
documents' attachments.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quoteproof.sources.readers import MOST_SEGMENTS, Segment, Unreadable, parse

# The limits of one message and the budget of one top-level document.
MOST_ATTACHMENTS, MOST_DEPTH = 50, 3
TOTAL_ATTACHMENTS, TOTAL_UNZIPPED = 100, 128 << 20


@dataclass
class Attachment:
    index: int
    name: str | None
    data: bytes | None = None
    mime: str | None = None
    message: Message | None = None
    by_value: bool = True


@dataclass
class Message:
    segments: list[Segment]
    attachments: list[Attachment] = field(default_factory=list)


@dataclass
class Budget:
    """What all attachments of a top-level document may use together."""

    attachments: int = TOTAL_ATTACHMENTS
    unzipped: list[int] = field(default_factory=lambda: [TOTAL_UNZIPPED])


@dataclass(frozen=True)
class Report:
    path: tuple[int, ...]
    name: str | None
    kind: str | None
    error: str | None
    segments: int

    @property
    def status(self) -> str:
        return "failed" if self.error else "parsed"


class _Expansion:
    """One top-level document: segments and reports lie in flat lists by their paths, and an attachment that fails is cut
    off at the place where it began."""

    def __init__(self, budget: Budget):
        self.budget = budget
        self.found: list[tuple[tuple[int, ...], Segment]] = []
        self.reports: list[Report] = []
        self.names: dict[tuple[int, ...], str | None] = {}

    def message(self, m: Message, path: tuple[int, ...]) -> None:
        start = len(self.found)
        self.found += [(path, s) for s in m.segments]
        for a in m.attachments:
            self.attachment(a, (*path, a.index), start)

    def attachment(self, a: Attachment, path: tuple[int, ...], outer: int) -> None:
        self.names[path] = a.name
        place, at = len(self.found), len(self.reports)
        self.reports.append(Report(path, a.name, None, None, 0))
        try:
            kind = self.opened(a, path)
            if len(self.found) - outer > MOST_SEGMENTS:
                raise Unreadable("document_too_long")
            self.reports[at] = Report(path, a.name, kind, None, len(self.found) - place)
        except Unreadable as e:
            del self.found[place:], self.reports[at:]
            self.reports.append(Report(path, a.name, None, e.code, 0))

    def opened(self, a: Attachment, path: tuple[int, ...]) -> str:
        for code, holds in (("too_many_attachments", a.index >= MOST_ATTACHMENTS), ("nesting_too_deep", len(path) > MOST_DEPTH), ("not_attached_by_value", not a.by_value), ("budget_exceeded", self.budget.attachments < 1)):
            if holds:
                raise Unreadable(code)
        self.budget.attachments -= 1
        if a.message is not None:
            self.message(a.message, path)
            return "msg"
        if a.data is None:
            raise Unreadable("document_unparseable")
        kind, inner = parse(a.data, a.mime, self.budget.unzipped)
        self.found += [(path, s) for s in inner]
        return kind

    def placed(self, path: tuple[int, ...], s: Segment) -> Segment:
        """A segment with the ids and places of the attachments around it."""
        locator = s.locator
        for n in range(len(path), 0, -1):
            locator = {"kind": "msg", "part": "attachment", "attachment": {"index": path[n - 1], "name": self.names[path[:n]]}, "inner": locator}
        return Segment("".join(f"msg-a{i}-" for i in path) + s.id, s.text, locator)


def expand(message: Message, budget: Budget | None = None) -> tuple[list[Segment], list[Report]]:
    """The message's segments with those of its attachments behind them (ids and places say which), and the reports."""
    run = _Expansion(budget or Budget())
    run.message(message, ())
    return [run.placed(path, s) for path, s in run.found], run.reports


# --- the same limits over a table of attachments


def _outside(nodes: DataFrame, failed: Column, order: WindowSpec, end: Column) -> DataFrame:
    """``nodes`` without those that lie, at any depth, in one for which ``failed`` holds.

    In the order of their paths, what lies in an attachment comes right behind it and ends before ``end``; such stretches are nested
    or apart, so a node lies in a failed one if the greatest end of those so far is behind its own.
    """
    reached = F.max(F.when(failed, end)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = F.coalesce((reached > end) & F.col("document_id").isNotNull(), F.lit(False))
    return nodes.withColumn("_inside", inside).where("not _inside").drop("_inside")


def reports(attachments: DataFrame, most: int = TOTAL_ATTACHMENTS, unzipped: int = TOTAL_UNZIPPED) -> DataFrame:
    """document_id, path, name, status, error of every attachment that is looked at, as ``expand`` reports them.

    ``attachments``: document_id, path (array of indexes from the document down), name, by_value, unzipped (bytes that it unpacks
    to, 0 of what is no package) and error (what its reader says; null where it is read). What lies in a refused attachment is not
    looked at. Attachments are counted in the order of their paths; a package that does not fit into what is left of the bytes is
    refused and takes nothing, so later ones may fit: these are folded in turn, at most ``most`` of a document, and only where
    they do not fit together. All is one pass over the attachments in order.
    """
    index, depth = F.element_at("path", -1), F.size("path")
    order = Window.partitionBy("document_id").orderBy("path")
    own = F.when(index >= MOST_ATTACHMENTS, "too_many_attachments").when(depth > MOST_DEPTH, "nesting_too_deep").when(~F.col("by_value"), "not_attached_by_value")
    end = F.concat(F.slice(F.col("path").cast("array<long>"), F.lit(1), depth - 1), F.array(index.cast("long") + 1))
    told = attachments.withColumn("_own", own).withColumn("_end", end)
    seen = _outside(told, F.col("_own").isNotNull(), order, F.col("_end"))
    turn = F.sum(F.col("_own").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = seen.withColumn("_own", F.when(F.col("_own").isNull() & (turn > most), "budget_exceeded").otherwise(F.col("_own")))
    counted = _outside(counted, F.col("_own") == "budget_exceeded", order, F.col("_end"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    package = F.col("_own").isNull() & (F.col("unzipped") > 0) & F.col("document_id").isNotNull()

    def turned(acc: Column, x: Column) -> Column:
        fits = x["unzipped"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] - x["unzipped"]).otherwise(acc["left"]).alias("left"), F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(x["path"]))).alias("out"))

    nothing = F.struct(F.lit(unzipped).cast("long").alias("left"), F.array().cast(attachments.select(F.array("path")).schema[0].dataType).alias("out"))
    packed = counted.withColumn("_package", package).withColumn("_sum", F.sum(F.when(F.col("_package"), F.col("unzipped").cast("decimal(38,0)"))).over(whole))
    packed = packed.withColumn("_p", F.collect_list(F.when(F.col("_package") & (F.col("_sum") > unzipped), F.struct("path", "unzipped"))).over(whole))
    refused = F.when(F.col("_package") & (F.size("_p") > 0), F.array_contains(F.aggregate(F.array_sort("_p"), nothing, turned, lambda acc: acc["out"]), F.col("path")))
    error = F.coalesce("_own", F.when(refused, "budget_exceeded"), "error")
    return packed.select("document_id", "path", "name", error.alias("error")).select("document_id", "path", "name", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status"), "error")
