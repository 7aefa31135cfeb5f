"""Is a ledger whole, and do its sources still say what they said: anti-joins, and a full outer join of inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.plans.materialize import written
from factgraph.plans.model import Ledger


def assets_without_evidence(ledger: Ledger) -> DataFrame:
    return ledger.assets.join(ledger.evidence.select(F.col("asset_id").alias("id")), "id", "left_anti")


def relationships_without_evidence(ledger: Ledger) -> DataFrame:
    return ledger.relationships.join(ledger.evidence.select(F.col("relationship_id").alias("id")), "id", "left_anti")


def orphaned_evidence(ledger: Ledger) -> DataFrame:
    return ledger.evidence.join(ledger.sources.select(F.col("id").alias("source_id")), "source_id", "left_anti")


REFERENCES = (
    ("assets", "source_id", "sources"), ("relationships", "from_id", "assets"), ("relationships", "to_id", "assets"),
    ("evidence", "source_id", "sources"), ("evidence", "asset_id", "assets"), ("evidence", "relationship_id", "relationships"),
)


#: References whose values repeat so often that few are left when they are told apart.
REPEATED = {("relationships", "from_id"), ("relationships", "to_id"), ("evidence", "source_id")}


def ids(to: DataFrame, column: str) -> DataFrame:
    """The ids of a table, to be met by merging: read alone they look small enough to be sent to all, but each task would then hold those of the whole table."""
    return to.select(F.col("id").alias(column)).hint("merge")


def lost(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """The different values of a column that lead nowhere, written: values are moved alone and once a task, and where few are lost the rows that hold them are not moved."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return written(values.join(ids(to, column), column, "left_anti"), f"lost-{column}")


def foreign_key_violations(ledger: Ledger, only: str | None = None) -> DataFrame:
    """(table, column, value): references that lead nowhere, of all tables or of one; null references lead nowhere by design."""

    def check(name: str, column: str, to: str) -> DataFrame:
        df, there = getattr(ledger, name), getattr(ledger, to)
        if (name, column) in REPEATED:
            found = df.join(lost(df, column, there), column, "left_semi")
        else:
            found = df.filter(F.col(column).isNotNull()).join(ids(there, column), column, "left_anti")
        return found.select(F.lit(name).alias("table"), F.lit(column).alias("column"), F.col(column).alias("value"))

    return reduce(DataFrame.unionByName, [check(*r) for r in REFERENCES if only in (None, r[0])])


def one_target(ledger: Ledger) -> DataFrame:
    """Evidence that stands for both or neither of an asset and a relationship."""
    return ledger.evidence.filter(F.col("asset_id").isNull() == F.col("relationship_id").isNull())


def folder_digests(inventory: DataFrame) -> DataFrame:
    """(folder, files, digest): for each folder of files (path, sha256), their number and a sum of digests of each with its name, which does not depend on their order and is summed where the files are."""
    one = F.sha2(F.concat_ws("\n", "path", F.coalesce("sha256", F.lit("?"))), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return inventory.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.concat_ws(":", *parts).alias("digest"))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def changed_folders(then: DataFrame, now: DataFrame) -> DataFrame:
    a, b = folder_digests(then), folder_digests(now).select("folder", F.col("files").alias("files_now"), F.col("digest").alias("digest_now"))
    same = F.coalesce((F.col("files") == F.col("files_now")) & (F.col("digest") == F.col("digest_now")), F.lit(False))
    return a.join(b, "folder", "full_outer").filter(~same).select("folder")


def inventory_diff(then: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of inventories (path, sha256): added, changed or removed since then. Only files of folders that differ meet each other."""
    changed = changed_folders(then, now)
    within = lambda df, name: df.select("path", F.col("sha256").alias(name), folder_of(F.col("path")).alias("folder")).join(changed, "folder", "left_semi").drop("folder")
    a, b = within(then, "old"), within(now, "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def _checks(ledger: Ledger) -> list[tuple[str, DataFrame]]:
    return [
        ("foreign-key violations", foreign_key_violations(ledger).select(F.col("value").alias("id"))),
        ("assets without evidence", assets_without_evidence(ledger).select("id")),
        ("relationships without evidence", relationships_without_evidence(ledger).select("id")),
        ("orphaned evidence", orphaned_evidence(ledger).select("id")),
    ]


def verdicts(ledger: Ledger) -> DataFrame:
    """(check, failures): how many records fail each check, none included."""
    counted = [df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures") for name, df in _checks(ledger)]
    return reduce(DataFrame.unionByName, counted)


def structural_issues(ledger: Ledger) -> list[str]:
    """One line per failed check, with the least record that fails it."""
    firsts = [(name, df.agg(F.min("id").alias("id")).first().id) for name, df in _checks(ledger)]
    return [f"{name} (record {i})" for name, i in firsts if i is not None]


def drift_issues(then: DataFrame, now: DataFrame) -> list[str]:
    said = {
        "added": "new supported source {!r} is not scanned; rerun scan and build",
        "changed": "scan input {!r} changed or is unavailable; rerun scan and build",
        "removed": "scan input {!r} was removed or excluded; rerun scan and build",
    }
    return sorted(said[r.change].format(r.path).replace("'", '"') for r in inventory_diff(then, now).collect())
