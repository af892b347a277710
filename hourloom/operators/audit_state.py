"""The integrity audit kept up to date: a stored summary, and what a batch of edits changes.

Edits change the log alone, so the counts of the other tables stay. For the log's own, the
entries of the touched slots are counted before and after the batch; groups that reach over
slots (a person's day, a repeated id) are looked up in the summary. Neither the log nor the
summary is read beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators import audit
from hourloom.schema import GRID_HOURS, SLOT, Tables

_DAY = ["userId", "dateStamp"]
_REPEATED = "id long, n long"
_FINDINGS = "finding string, n long"


@dataclass(frozen=True)
class Audited:
    """Folders of the findings, of the ids that occur more than once, and per year of the
    summary: one row per slot and person."""

    findings: str
    repeated: str
    summary: dict[int, str]

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_FINDINGS).parquet(self.findings)


def _checks(fact: DataFrame) -> dict[str, Column]:
    return audit.entry_checks(fact)


def _summary_rows(spark: SparkSession, state: Audited, years: list[int], like: DataFrame) -> DataFrame:
    folders = [state.summary[y] for y in years if y in state.summary]
    if not folders:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(*folders)


def _save_summary(rows: DataFrame, path: str) -> dict[int, str]:
    spark = rows.sparkSession
    yearly = rows.withColumn("year", F.year("dateStamp"))
    yearly.hint("rebalance", "year").write.partitionBy("year").parquet(path)
    years = spark.read.schema(yearly.schema).parquet(path).select("year").distinct().collect()
    return {r.year: f"{path}/year={r.year}" for r in years}


def start_audit(t: Tables, path: str) -> Audited:
    """Audit all tables, whose entries have ids, and store what later audits build on."""
    summary = _save_summary(audit.summed_entries(t.fact, _checks(t.fact)), f"{path}/summary")
    repeated = t.fact.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated.write.parquet(f"{path}/repeated")
    audit.integrity_audit(t, ("id",)).write.parquet(f"{path}/findings")
    return Audited(f"{path}/findings", f"{path}/repeated", summary)


def _log_findings(t: Tables, summary: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The findings that a slot's own entries decide."""
    parts = [
        audit.summed(summary, checks),
        audit.slot_findings(summary),
        audit.orphans(summary, "main: user unknown", "userId", t.user, "_rows"),
        audit.orphans(summary, "main: project unknown", "projectId", t.project, "_rows"),
        audit.orphans(summary, "main: stage unknown", "stageId", t.stage, "_rows"),
    ]
    return reduce(DataFrame.unionByName, parts).select("finding", "n")


def _difference(after: DataFrame, before: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key what is more after than before."""
    signed = after.select(*keys, F.col(value)).unionByName(before.select(*keys, (-F.col(value)).alias(value)))
    return signed.groupBy(*keys).agg(F.sum(value).alias(value))


def audit_after(state: Audited, t: Tables, before: DataFrame, after: DataFrame, path: str) -> Audited:
    """The state after a batch of edits. `before` and `after` are the entries of the touched
    slots, all of them; `t` has the other tables. Results go to the new folder `path`, the
    summary only for the years of the touched slots."""
    spark = before.sparkSession
    checks = _checks(before)
    old, new = audit.summed_entries(before, checks), audit.summed_entries(after, checks)
    both = before.unionByName(after)
    years = sorted(r[0] for r in both.select(F.year("dateStamp")).distinct().collect())
    low, high = both.agg(F.min("dateStamp"), F.max("dateStamp")).first()
    stored = _summary_rows(spark, state, years, old)

    counts = _difference(_log_findings(t, new, checks), _log_findings(t, old, checks), ["finding"], "n")

    hours = lambda s: s.groupBy(*_DAY).agg(F.sum("_hours").alias("_hours"))
    change = _difference(hours(new), hours(old), _DAY, "_hours").withColumnRenamed("_hours", "_more")
    days = stored.filter(F.col("dateStamp").between(F.lit(low), F.lit(high)))
    known = hours(days.join(change.select(*_DAY), _DAY, "left_semi"))
    long_days = change.join(known, _DAY, "left").withColumn("_hours", F.coalesce("_hours", F.lit(0)))
    days_found = _crossing("main: day too long", long_days, F.col("_hours"), F.col("_more"), GRID_HOURS)

    ids = lambda rows: rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    repeated = spark.read.schema(_REPEATED).parquet(state.repeated)
    moved = _difference(ids(after), ids(before), ["id"], "n").withColumnRenamed("n", "_more")
    seen = moved.join(ids(before).withColumnRenamed("n", "_here"), "id", "left").join(repeated, "id", "left")
    seen = seen.withColumn("n", F.coalesce("n", "_here", F.lit(0)))
    ids_found = _crossing("main: key repeated", seen, F.col("n"), F.col("_more"), 1)

    changes = counts.unionByName(days_found).unionByName(ids_found).withColumnRenamed("n", "_more")
    findings = state.result(spark).join(changes, "finding", "left")
    findings.select("finding", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")).write.parquet(
        f"{path}/findings"
    )
    left = seen.select("id", (F.col("n") + F.col("_more")).alias("n"))
    repeated.join(left, "id", "left_anti").unionByName(left).filter("n > 1").write.parquet(f"{path}/repeated")
    slots = both.select(*SLOT).distinct()
    kept = stored.join(slots, SLOT, "left_anti")
    written = _save_summary(kept.unionByName(new), f"{path}/summary")
    others = {y: f for y, f in state.summary.items() if y not in years}
    return Audited(f"{path}/findings", f"{path}/repeated", others | written)


def _crossing(finding: str, rows: DataFrame, value: Column, more: Column, limit: int) -> DataFrame:
    """How many more groups are beyond a limit than before."""
    over = (value + more > limit).cast("long") - (value > limit).cast("long")
    total = rows.agg(F.coalesce(F.sum(over), F.lit(0)).alias("n"))
    return total.select(F.lit(finding).alias("finding"), "n")
