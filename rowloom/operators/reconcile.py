"""Two-way reconciliation: equal rows and the chosen side of every difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.tables import TableDiff
from rowloom.plans.options import UnresolvedError, UsageError

#: Choices that are broadcast; beyond it they are joined by shuffle.
BROADCAST_CHOICES = 200_000


def resolve(diff: TableDiff, choices: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """The differences with ``choice`` and ``unresolved``; ``choices``: (id, choice) with choice left or right."""
    if default not in (None, "left", "right"):
        raise UsageError("the default choice is left or right")
    rows = diff.identified
    if choices is not None:
        c = choices.select("id", "choice").filter("choice in ('left', 'right')").dropDuplicates(["id"])
        rows = rows.join(F.broadcast(c) if c.count() <= BROADCAST_CHOICES else c, "id", "left")
    else:
        rows = rows.withColumn("choice", F.lit(None).cast("string"))
    rows = rows.withColumn("unresolved", F.col("choice").isNull() & F.lit(default is None))
    return rows.withColumn("choice", F.coalesce("choice", F.lit(default or "left")))


def reconcile(diff: TableDiff, choices: DataFrame | None = None, default: str | None = None, allow_unresolved: bool = False) -> DataFrame:
    """The reconciled table. A one-sided row stays if its own side is chosen; of a pair the chosen side stays."""
    rows = resolve(diff, choices, default)
    if default is None and not allow_unresolved and rows.filter("unresolved").limit(1).count():
        raise UnresolvedError("differences without a choice")
    chosen = F.when(F.col("choice") == "left", F.col("old")).otherwise(F.col("new"))
    kept = rows.withColumn("row", chosen).filter("row is not null")
    cols = [F.col("row")[c].alias(n) for c, n in zip(diff.names, diff.plan.columns, strict=True)]
    return diff.equal().unionByName(kept.select(*cols))


def unresolved_rows(diff: TableDiff, choices: DataFrame | None = None, default: str | None = None) -> int:
    return resolve(diff, choices, default).filter("unresolved").count()
