"""Session defaults and tenant-scoped table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def session(app: str = "quoteproof", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


class TenantSession:
    """Every table read is filtered by the tenant; a missing or malformed tenant sees no row.

    ``column`` should be the tables' partition column, so that the filter prunes files.
    """

    def __init__(self, tables, tenant, column: str = "company_id", pattern: str = UUID):
        self.tables, self.column = tables, column
        self.tenant = tenant if tenant is not None and re.match(pattern, str(tenant)) else None

    def table(self, name: str) -> DataFrame:
        return self.tables(name).where(F.col(self.column) == F.lit(self.tenant))

    def check(self, df: DataFrame, tables: dict[str, str] | None = None) -> DataFrame:
        """``df``, if no tenant table is read in it without this tenant's predicate; else raises PermissionError.

        ``tables``: path ending of a tenant table to its tenant column (default: every relation that has the column).
        """
        bare = unscoped(df, self.tenant, self.column, tables)
        if bare:
            raise PermissionError("read without the tenant's predicate: " + ", ".join(sorted(bare)))
        return df


def _seq(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _pinned(condition, tenant) -> set[int]:
    """Ids of the columns that a condition pins to the tenant."""
    if _kind(condition) == "And":
        return _pinned(condition.left(), tenant) | _pinned(condition.right(), tenant)
    if _kind(condition) != "EqualTo" or tenant is None:
        return set()
    sides = [condition.left(), condition.right()]
    while any(_kind(s) == "Cast" for s in sides):
        sides = [s.child() if _kind(s) == "Cast" else s for s in sides]
    columns = [s for s in sides if _kind(s) == "AttributeReference"]
    values = [s for s in sides if _kind(s) == "Literal" and s.toString() == str(tenant)]
    return {columns[0].exprId().id()} if len(columns) == len(values) == 1 else set()


#: Nodes that pass rows on as they are, so that a predicate above them holds for the rows below that reach the result.
_TRANSPARENT = ("SubqueryAlias", "Sort", "Project", "Filter", "Join", "Repartition", "RepartitionByExpression", "ResolvedHint", "Distinct", "View")


def unscoped(df: DataFrame, tenant, column: str, tables: dict[str, str] | None = None) -> set[str]:
    """Paths of tenant tables that the analysed plan of ``df`` reads with no predicate on the tenant above them, subqueries too.

    A predicate counts for a relation if it pins the relation's own tenant column to this tenant and only nodes that keep rows as
    they are lie between; behind aggregates, windows, limits, unions and renamed columns it does not count, so such a plan is
    refused unless the predicate stands below them. None as the tenant pins nothing.
    """
    out: set[str] = set()

    def relation(node, pinned: set[int]) -> None:
        output = {a.name(): a.exprId().id() for a in _seq(node.output())}
        for path in (p.toString() for p in _seq(node.relation().location().rootPaths())):
            own = column if tables is None else next((c for end, c in tables.items() if path.rstrip("/").endswith(end)), None)
            listed = own in output if tables is None else own is not None
            if listed and output.get(own) not in pinned:
                out.add(path)

    def walk(node, pinned: set[int]) -> None:
        kind = _kind(node)
        for subquery in _seq(node.subqueries()):
            walk(subquery, set())
        if kind == "LogicalRelation":
            relation(node, pinned)
        below = pinned | _pinned(node.condition(), tenant) if kind == "Filter" else pinned if kind in _TRANSPARENT else set()
        for child in _seq(node.children()):
            walk(child, below)

    walk(df._jdf.queryExecution().analyzed(), set())
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all machines see: below spark.checkpoint.dir, or a temporary one where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="quoteproof-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
