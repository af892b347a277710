"""Named queries over the driver's tables: every operator for all projects and people."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import labels
from hourloom.operators import (
    audit,
    audit_state,
    calendar,
    cards,
    directory,
    edits,
    gantt,
    lines,
    maintenance,
    matrix,
    worklog,
)
from hourloom.plans.periods import in_period
from hourloom.schema import ALL, ARCHIVED, CURRENT, FACT, SCHEMAS, SLOT, STAGE_NAMES, Tables
from hourloom.session import fresh_dir, shared_dir
from hourloom.sources import cache, dump, snapshots, tables, views
from hourloom.streaming import edit_stream

YEAR, MONTH = 1997, 3
TODAY = dt.date(2002, 1, 1)
CAL_TODAY = dt.date(2024, 1, 15)

Query = Callable[[SparkSession, str], DataFrame]


def _wl(build: Callable[[Tables], DataFrame], dated: bool = False) -> Query:
    return lambda spark, sf_dir: build(views.long_log(spark, sf_dir, dated))


def _cal(build: Callable[[Tables], DataFrame], folded: bool = False) -> Query:
    return lambda spark, sf_dir: build(views.month_log(spark, sf_dir, folded))


# ---------------------------------------------------------------- lookups


def _lookups(t: Tables) -> DataFrame:
    """All lookups, asked for the keys that occur in the log (ids), for every login in
    capitals and for every name, in one long result."""
    user_keys = t.fact.select(F.col("userId").alias("id"))
    project_keys = t.fact.select(F.col("projectId").alias("id"))
    logins = t.user.select(F.upper("username").alias("login"))
    names = t.user.select(F.lower("name").alias("name"))

    def rows(kind: str, df: DataFrame, key: str, value: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(key).cast("string").alias("key"),
            F.col(value).cast("string").alias("value"),
        )

    return (
        rows("user", directory.users_by_id(t, user_keys), "id", "username")
        .unionByName(rows("user name", directory.user_names_by_id(t, user_keys), "id", "name"))
        .unionByName(rows("login", directory.logins_by_id(t, user_keys), "id", "login"))
        .unionByName(rows("project", directory.projects_by_id(t, project_keys), "id", "square"))
        .unionByName(rows("project name", directory.project_names_by_id(t, project_keys), "id", "name"))
        .unionByName(rows("project title", directory.project_titles_by_id(t, project_keys), "id", "title"))
        .unionByName(rows("user of login", directory.users_by_login(t, logins), "login", "id"))
        .unionByName(rows("login of name", directory.logins_by_name(t, names), "asked", "login"))
    )


# ---------------------------------------------------------------- edits


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events")


def _named(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("projectId").alias("project_id"),
        F.col("stageId").alias("stage_id"),
        F.col("dateStamp").alias("date"),
        F.col("userId").alias("user_id"),
        "hours",
    )


def _new_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACT)


def _upsert(spark: SparkSession, sf_dir: str) -> edits.Outcome:
    """All events as sets on a new log."""
    events = _events(spark, sf_dir)
    return edits.upsert_entries(_new_log(spark), views.calendar_edits(events, deletes=False))


def _upsert_over(spark: SparkSession, sf_dir: str) -> edits.Outcome:
    """All events as sets by the next user id, on a log that holds all events."""
    events = _events(spark, sf_dir)
    commands = views.calendar_edits(events, deletes=False, next_user=True)
    return edits.upsert_entries(views.calendar_facts(events), commands)


def _mixed(spark: SparkSession, sf_dir: str, folded: bool = False) -> edits.Outcome:
    """All events as sets and deletes on a new log."""
    events = _events(spark, sf_dir)
    return edits.apply_edits(_new_log(spark), views.calendar_edits(events, folded))


def _mixed_over(spark: SparkSession, sf_dir: str) -> edits.Outcome:
    """All events as sets and deletes by the next user id, on a log that holds all events, so
    doubled and over-full slots occur."""
    events = _events(spark, sf_dir)
    commands = views.calendar_edits(events, next_user=True)
    return edits.apply_edits(views.calendar_facts(events), commands)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed edits as a stream over the events file, into a new log."""
    reader = spark.readStream.schema(views.SOURCE_SCHEMAS["events"])
    source = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    base = fresh_dir(spark, "edit-stream")
    edit_stream.run_available(views.calendar_edits(source), f"{base}/log", f"{base}/checkpoint")
    return _named(edit_stream.current_entries(spark, f"{base}/log"))


def _saved_month(spark: SparkSession, sf_dir: str, base: str) -> snapshots.YearFolders:
    snapshots.save_entries(views.calendar_facts(_events(spark, sf_dir)), f"{base}/main")
    return snapshots.year_folders(spark, f"{base}/main")


def _seeded_stream(spark: SparkSession, sf_dir: str, batches: int = 1) -> str:
    """The month's log saved, and mixed edits by the next user as a stream into it. The edits
    arrive in `batches` parts one after the other, those of a slot in one part; a part is as
    many files as the scan has tasks. The folder of the stream's log."""
    base = fresh_dir(spark, "edit-stream")
    start = _saved_month(spark, sf_dir, f"{base}/before")
    commands = views.calendar_edits(_events(spark, sf_dir), next_user=True)
    part = F.pmod(F.xxhash64(*SLOT), F.lit(batches).cast("long"))
    for n in range(batches):
        commands.filter(part == n).write.mode("append").parquet(f"{base}/in")
        source = edit_stream.read_edits(spark, f"{base}/in")
        edit_stream.run_available(source, f"{base}/log", f"{base}/checkpoint", start)
    return f"{base}/log"


def _by_day(entries: DataFrame) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("entries"), F.sum("hours").alias("hours")]
    return entries.groupBy(F.col("dateStamp").alias("date")).agg(*sums)


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month's log saved, then published with mixed edits by the next user; entries and
    hours per day of what is published."""
    base = fresh_dir(spark, "published")
    years = _saved_month(spark, sf_dir, f"{base}/before")
    commands = views.calendar_edits(_events(spark, sf_dir), next_user=True)
    done = snapshots.publish_edits(spark, years, f"{base}/after", commands)
    return _by_day(done.years.entries(spark))


def _long_log_saved(spark: SparkSession, sf_dir: str, base: str) -> snapshots.YearFolders:
    """The long log with ids, in year folders."""
    fact = views.long_log(spark, sf_dir).fact
    entry_id = (F.col("orderKey") * 8 + F.col("stageId")).alias("id")
    snapshots.save_entries(fact.select("*", entry_id), f"{base}/main")
    return snapshots.year_folders(spark, f"{base}/main")


def _per_year(years: snapshots.YearFolders, entries: DataFrame, target: str) -> DataFrame:
    """Entries and hours per year, and whether the year was written anew."""
    written = sorted(y for y, folder in years.folders.items() if folder.startswith(target))
    return entries.groupBy(F.year("dateStamp").alias("year")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("hours").alias("hours"),
    ).withColumn("written", F.col("year").isin(written).cast("int"))


def _published_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of one month deleted from the long log: one year is written anew."""
    base = fresh_dir(spark, "published")
    years = _long_log_saved(spark, sf_dir, f"{base}/before")
    done = snapshots.publish_edits(spark, years, f"{base}/after", _month_deletes(years, spark))
    return _per_year(done.years, done.years.entries(spark), f"{base}/after")


def _month_deletes(years: snapshots.YearFolders, spark: SparkSession) -> DataFrame:
    """A delete by its own person for every entry of one month."""
    month = years.entries(spark, [YEAR]).filter(in_period(F.col("dateStamp"), YEAR, MONTH))
    return month.select(
        F.to_timestamp("dateStamp").alias("ts"), F.col("id").alias("seq"), F.lit("delete").alias("op"),
        "userId", *SLOT, F.lit(1).alias("hour"),
    )


def _audit_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long log audited, every entry of one month deleted, and the audit brought up to
    date from the entries of the touched slots."""
    base = fresh_dir(spark, "audited")
    years = _long_log_saved(spark, sf_dir, f"{base}/before")
    t = views.long_log(spark, sf_dir)
    state = audit_state.start_audit(t.with_(fact=years.entries(spark)), f"{base}/first")
    deletes = _month_deletes(years, spark)
    done = snapshots.publish_edits(spark, years, f"{base}/after", deletes)
    touched = lambda log: log.entries(spark, [YEAR]).join(deletes.select(*SLOT).distinct(), SLOT, "left_semi")
    after = audit_state.audit_after(state, t, touched(years), touched(done.years), f"{base}/second")
    return after.result(spark)


def _published_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three projects, by id the first, the middle and the last one of one year's log, deleted
    from the log: the years they have entries in are written anew."""
    base = fresh_dir(spark, "published")
    years = _long_log_saved(spark, sf_dir, f"{base}/before")
    ids = years.entries(spark).filter(in_period(F.col("dateStamp"), YEAR)).agg(
        F.min("projectId").alias("a"), F.max("projectId").alias("b")
    )
    gone = ids.select(F.explode(F.array("a", F.floor((F.col("a") + F.col("b")) / 2), "b")).alias("id"))
    after = snapshots.publish_without(spark, years, f"{base}/after", gone, "projectId")
    return _per_year(after, after.entries(spark), f"{base}/after")


def _command_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as clicks by date parts; the month runs on past twelve, some hours are off
    the grid and some ops unknown. The clicks that are turned away."""
    key = F.col("event_id")
    clicks = _events(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"),
        key.alias("seq"),
        F.when(key % 11 == 0, F.lit("move")).otherwise(F.lit("set")).alias("op"),
        F.col("user_id").alias("userId"),
        F.lit(1).cast("long").alias("projectId"),
        F.lit(1).alias("stageId"),
        F.year("ts").alias("year"),
        (key % 13 + 1).cast("int").alias("month"),
        F.dayofmonth("ts").alias("day"),
        (key % 14).cast("int").alias("hour"),
    )
    return edits.read_commands(clicks)[1].select("seq", "reason")


# ---------------------------------------------------------------- maintenance


def _new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as new users: every fifth without a login, every third with a colour, and a
    text where a flag belongs now and then."""
    key = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.col("c_name").alias("name"),
        F.when(key % 5 != 0, F.lower("c_name")).alias("username"),
        F.when(key % 7 == 0, F.lit("yes")).alias("admin"),
        F.lit(None).cast("string").alias("relevant"),
        F.when(key % 3 == 0, F.concat(F.lit("#ff"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))).alias("color"),
    )


def _new_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as new projects: customer names are new but come twice (once
    in capitals); suppliers have no square; part names are taken already."""
    customer = views.table(spark, sf_dir, "customer")
    once = customer.select(
        (F.col("c_custkey") * 4).alias("seq"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("square"),
        F.to_date(F.lit("2001-05-05")).alias("stage2"),
    )
    again = customer.select(
        (F.col("c_custkey") * 4 + 1).alias("seq"),
        F.upper("c_name").alias("name"),
        F.lit("10").alias("square"),
        F.lit(None).cast("date").alias("stage2"),
    )
    bare = views.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 4 + 2).alias("seq"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("square"),
        F.lit(None).cast("date").alias("stage2"),
    )
    taken = views.table(spark, sf_dir, "part").select(
        (F.col("p_partkey") * 4 + 3).alias("seq"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.lit("5").alias("square"),
        F.lit(None).cast("date").alias("stage2"),
    )
    batch = once.unionByName(again).unionByName(bare).unionByName(taken)
    return batch.withColumn("isDone", F.lit(None).cast("string"))


def _m03_cascade(t: Tables) -> DataFrame:
    """Inactive users dropped; what is left of the log, per user."""
    after = maintenance.delete_users(t, t.user.filter(F.col("relevant") == 0))
    left = after.user.select("id").withColumn("n", F.lit(0)).unionByName(
        after.fact.groupBy(F.col("userId").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    return left.groupBy(F.col("id").alias("user_id")).agg(F.sum("n").alias("n"))


def _m03_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.long_log(spark, sf_dir)
    batch = maintenance.accepted(maintenance.check_new_users(_new_users(spark, sf_dir)))
    return maintenance.insert_users(t, batch).user


def _m03_update(t: Tables) -> DataFrame:
    """Active users get a colour, every third a name in capitals; NULL names are not named."""
    patch = t.user.filter(F.col("relevant") == 1).select(
        "id",
        F.col("id").alias("seq"),
        F.upper("name").alias("name"),
        F.lit("#4080ff").alias("color"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("name"), F.lit("color")))
        .otherwise(F.array(F.lit("color")))
        .alias("fields"),
    )
    return maintenance.update_users(t, patch).user


def _m04_cascade(t: Tables) -> DataFrame:
    """Finished projects dropped; rows left in each of the three tables, per project."""
    after = maintenance.delete_projects(t, t.project.filter(F.col("isDone") == 1))
    one = F.count(F.lit(1)).alias("n")
    return (
        after.project.groupBy(F.col("id").alias("project_id")).agg(one).withColumn("table", F.lit("project"))
        .unionByName(
            after.deadline.groupBy(F.col("projectId").alias("project_id")).agg(one).withColumn("table", F.lit("projectstage"))
        )
        .unionByName(
            after.fact.groupBy(F.col("projectId").alias("project_id")).agg(one).withColumn("table", F.lit("main"))
        )
    )


def _m04_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects with their six deadlines after the accepted ones came in."""
    t = views.long_log(spark, sf_dir, dated=True)
    checked = maintenance.check_new_projects(t, _new_projects(spark, sf_dir))
    after = maintenance.insert_projects(t, maintenance.accepted(checked), TODAY)
    dates = after.deadline.withColumnRenamed("projectId", "id")
    return after.project.join(dates, "id").select(
        "id", "name", "square", "level", "startdate", F.col("isDone").alias("is_done"),
        F.col("stageId").alias("stage_id"), F.col("finishdate").alias("finish_date"),
    )


def _m05_patch(t: Tables) -> DataFrame:
    """Stages 2 and 5 of current projects move a week after the project's start."""
    patch = t.project.filter(F.col("isDone") == 0).select(
        F.col("id").alias("projectId"),
        F.col("id").alias("seq"),
        F.explode(F.array(F.lit(2), F.lit(5))).alias("stageId"),
        F.date_add("startdate", 7).alias("finishdate"),
    )
    return maintenance.patch_deadlines(t, patch).deadline.select(
        F.col("projectId").alias("project_id"),
        F.col("stageId").alias("stage_id"),
        F.col("finishdate").alias("finish_date"),
    )


def _m03_update_rejects(t: Tables) -> DataFrame:
    """Users get a flag and a colour; every fourth flag is a text and every third colour is
    unreadable. The rows that are turned away."""
    key = F.col("id")
    patch = t.user.select(
        "id",
        key.alias("seq"),
        F.when(key % 4 == 0, F.lit("yes")).otherwise(F.lit("1")).alias("admin"),
        F.when(key % 3 == 0, F.lit("#zz0000")).otherwise(F.lit("#102030")).alias("color"),
        F.array(F.lit("admin"), F.lit("color")).alias("fields"),
    )
    return maintenance.rejected(maintenance.check_user_patch(patch)).select("seq", "reason")


def _m04_update(t: Tables) -> DataFrame:
    """Every tenth project asks for the next one's name, which is taken; the ones after them
    ask for a new name two by two, so the first of each two gets it and both are finished."""
    key = F.col("id")
    patch = t.project.filter(key % 10 < 2).select(
        "id",
        key.alias("seq"),
        F.lit("1").alias("isDone"),
        (key + 1).alias("_next"),
    )
    names = t.project.select(key.alias("_next"), F.col("name").alias("_taken"))
    asked = patch.join(names, "_next").select(
        "id",
        "seq",
        "isDone",
        F.when(key % 10 == 0, F.col("_taken"))
        .otherwise(F.concat(F.lit("Renamed "), F.floor(key / 20).cast("string")))
        .alias("name"),
        F.array(F.lit("name"), F.lit("isDone")).alias("fields"),
    )
    finished = patch.select(
        "id", (key + 10_000_000).alias("seq"), "isDone",
        F.lit(None).cast("string").alias("name"), F.array(F.lit("isDone")).alias("fields"),
    )
    changes = asked.unionByName(finished.filter(key % 10 == 1))
    return maintenance.update_projects(t, changes).project.select(
        "id", "name", F.col("isDone").alias("is_done")
    )


def _m05_patch_repeated(t: Tables) -> DataFrame:
    """Stage 2 of each project moves twice; the later move counts."""
    moves = t.project.select(
        F.col("id").alias("projectId"),
        F.lit(2).alias("stageId"),
        F.posexplode(F.array(F.date_add("startdate", 14), F.date_add("startdate", 7))).alias("n", "finishdate"),
    ).withColumn("seq", F.col("projectId") * 2 + F.lit(1) - F.col("n"))
    return maintenance.patch_deadlines(t, moves.drop("n")).deadline.select(
        F.col("projectId").alias("project_id"),
        F.col("stageId").alias("stage_id"),
        F.col("finishdate").alias("finish_date"),
    )


def _m06_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.long_log(spark, sf_dir)
    users = maintenance.rejected(maintenance.check_new_users(_new_users(spark, sf_dir)))
    projects = maintenance.rejected(maintenance.check_new_projects(t, _new_projects(spark, sf_dir)))
    return users.select(F.lit("user").alias("batch"), "seq", "reason").unionByName(
        projects.select(F.lit("project").alias("batch"), "seq", "reason")
    )


def _cells(df: DataFrame) -> DataFrame:
    """A map of hours as text, `name=hours` joined by semicolons."""
    pairs = F.transform(F.map_entries("hours"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return df.withColumn("cells", F.array_join(pairs, ";")).drop("hours")


def _cards_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of two years from the stored summary of the log."""
    t = views.long_log(spark, sf_dir)
    path = fresh_dir(spark, "cards")
    summary = cards.yearly_summary(t.fact)
    summary.write.partitionBy("year").parquet(path)
    return cards.cards_of_years(t, spark.read.schema(summary.schema).parquet(path), YEAR, YEAR + 1)


# ---------------------------------------------------------------- ingest, cache


def _literal(column: str) -> Column:
    text = F.replace(F.col(column).cast("string"), F.lit("'"), F.lit("''"))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user table written as dump text, one statement per part file, and read back. The
    dump carries a login secret, which the ingest leaves out."""
    user = views.long_log(spark, sf_dir).user
    path = fresh_dir(spark, "dump")
    columns = ["id", "name", "color", "username", "admin", "relevant"]
    values = F.concat_ws(", ", *[_literal(c) for c in columns], F.lit("'123'"))
    names = ", ".join(f"`{c}`" for c in [*columns, "password"])
    header = f"INSERT INTO `user` ({names}) VALUES\n"
    line = F.concat(F.lit(header + "\t("), values, F.lit(");\n"))
    user.select(line.alias("value")).write.text(path)
    return dump.dump_table(spark, path, "user")


def _statements(name: str, rows: DataFrame) -> DataFrame:
    """Dump text of a table: statements of up to 500 tuples, each on lines of its own. A task
    writes its rows as they come and holds one batch of them."""
    columns = SCHEMAS[name].fieldNames()
    header = f"INSERT INTO `{name}` ({', '.join(f'`{c}`' for c in columns)}) VALUES\n"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tuples = batch.column(0).to_pylist()
            texts = [
                header + ",\n".join(tuples[i : i + 500]) + ";\n" for i in range(0, len(tuples), 500)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    values = F.concat_ws(", ", *[_literal(c) for c in columns])
    tuples = rows.select(F.concat(F.lit("\t("), values, F.lit(")")).alias("tuple"))
    return tuples.mapInArrow(joined, "value string")


def _ingested_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five tables of the long log written as dump text and ingested; rows and a sum of
    each."""
    t = views.long_log(spark, sf_dir, dated=True)
    path, root = fresh_dir(spark, "dump"), fresh_dir(spark, "ingested")
    given = {
        "main": t.fact.withColumn("id", F.monotonically_increasing_id() + 1),
        "project": t.project,
        "projectstage": t.deadline,
        "stage": t.stage,
        "user": t.user,
    }
    texts = [_statements(name, df) for name, df in given.items()]
    reduce(DataFrame.unionByName, texts).write.text(path)
    dump.ingest_dump(spark, path, root)
    back = tables.load_tables(spark, root)
    sums = {
        "main": (back.fact, F.sum("hours")),
        "project": (back.project, F.sum("square")),
        "projectstage": (back.deadline, F.count("finishdate")),
        "stage": (back.stage, F.sum("id")),
        "user": (back.user, F.sum("relevant")),
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), total.cast("long").alias("total")).withColumn("table", F.lit(name))
        for name, (df, total) in sums.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.long_log(spark, sf_dir)
    version = cache.data_version(t)
    report = lambda: matrix.user_project_hours(t, YEAR)
    stored = cache.materialised(
        spark, shared_dir(spark), "user_project_hours", {"year": YEAR}, version, report
    )
    return stored.drop("header")


def _cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over two years stored, then asked for again by the data alone; the second time
    it must not be built. Beside it the report over the log with a day moved, whose data
    differ, so it is stored apart."""
    base = fresh_dir(spark, "cache")
    t = views.long_log(spark, sf_dir)

    def asked(given: Tables, build: Callable[[], DataFrame]) -> DataFrame:
        version = cache.fingerprint(given.fact)
        return cache.materialised(spark, base, "hours_by_year", {}, version, build)

    def refused() -> DataFrame:
        raise RuntimeError("the stored report must be found")

    report = lambda given: lambda: worklog.grouped_hours(given, year=ALL)
    asked(t, report(t))
    again = views.long_log(spark, sf_dir)
    hit = asked(again.with_(fact=again.fact.repartition("userId")), refused)
    moved = t.with_(fact=t.fact.withColumn("dateStamp", F.date_add("dateStamp", 365)))
    later = asked(moved, report(moved))
    return hit.withColumn("moved", F.lit(0)).unionByName(later.withColumn("moved", F.lit(1)))


def queries() -> dict[str, Query]:
    w = worklog
    return {
        "r01_cards_current_year": _wl(lambda t: cards.project_cards(t, CURRENT, YEAR)),
        "r01_cards_archived": _wl(lambda t: cards.project_cards(t, ARCHIVED)),
        "r01_cards_all": _wl(cards.project_cards),
        "r01_cards_scoped": _wl(lambda t: cards.project_cards(t, None, YEAR, scoped=True)),
        "r01_cards_of_years": _cards_of_years,
        "r02_status_counts": _wl(cards.status_counts),
        "r02_current_count": _wl(cards.count_projects),
        "r03_user_status_counts": _wl(cards.user_status_counts),
        "r03_one_user": _wl(lambda t: cards.count_projects_of(t, 3)),
        "r04_years": _wl(w.active_years),
        "r05_facets": _wl(w.filter_facets),
        "r06_chart_facets": _wl(lambda t: w.chart_facets(t, TODAY)),
        "r07_page": _wl(lambda t: w.worklog_page(t, page=2)),
        "r07_page_done": _wl(lambda t: w.worklog_page(t, page=2, relevant=0)),
        "r07_page_deep": _wl(lambda t: w.worklog_page(t, page=1000)),
        "r07_page_after": _wl(
            lambda t: w.worklog_after(
                t,
                {
                    "dateStamp": dt.date(1999, 6, 15),
                    "orderKey": 100,
                    "stageId": 0,
                    "projectId": 0,
                    "userId": 0,
                    "hours": 0,
                },
            )
        ),
        "r08_count": _wl(w.worklog_count),
        "r08_count_current": _wl(lambda t: w.worklog_count(t, relevant=1)),
        "r09_by_year": _wl(lambda t: w.grouped_hours(t, year=ALL)),
        "r09_by_year_month": _wl(lambda t: w.grouped_hours(t, year=ALL, month=ALL)),
        "r09_by_date": _wl(lambda t: w.grouped_hours(t, year=ALL, month=ALL, day=ALL)),
        "r09_by_user": _wl(lambda t: w.grouped_hours(t, user=ALL)),
        "r09_by_project_size": _wl(lambda t: w.grouped_hours(t, square=ALL)),
        "r09_by_stage_user": _wl(lambda t: w.grouped_hours(t, stage=STAGE_NAMES[1], user=ALL)),
        "r09_by_user_fixed": _wl(
            lambda t: w.grouped_hours(t, user="Supplier#000000007", year=ALL, project=ALL)
        ),
        "r09_by_relevant_project": _wl(lambda t: w.grouped_hours(t, relevant=1, project=ALL)),
        "r09_by_relevant_year": _wl(lambda t: w.grouped_hours(t, relevant=0, year=YEAR, month=ALL)),
        "r09_by_all_fields": _wl(
            lambda t: w.grouped_hours(
                t, year=ALL, month=ALL, day=ALL, user=ALL, project=ALL, square=ALL, stage=ALL
            )
        ),
        "r09_merged_names": _wl(lambda t: w.grouped_hours(t, user=ALL, merge_names=True)),
        "r10_lines_month": _wl(lambda t: lines.project_lines(t, YEAR)),
        "r10_lines_day": _wl(lambda t: lines.project_lines(t, YEAR, MONTH)),
        "r11_user_lines": _wl(lambda t: lines.user_lines(t, YEAR)),
        "r12_gaps": _wl(
            lambda t: lines.with_breaks(lines.project_lines(t, YEAR), ["project_id", "user_id"])
        ),
        "r12_user_gaps": _wl(
            lambda t: lines.with_breaks(lines.user_lines(t, YEAR, MONTH), ["user_id", "project_id"])
        ),
        "r13_matrix_long": _wl(lambda t: matrix.stage_matrix(t, YEAR)),
        "r13_matrix_month": _wl(lambda t: matrix.stage_matrix(t, YEAR, MONTH)),
        "r13_matrix_wide": _wl(lambda t: matrix.stage_matrix_wide(t, 1, YEAR)),
        "r13_matrix_maps": _wl(
            lambda t: _cells(matrix.stage_matrix_maps(t, YEAR)).drop("stage_order")
        ),
        "r14_user_maps": _wl(lambda t: _cells(matrix.user_project_maps(t, YEAR))),
        "p12_headers": _wl(lambda t: matrix.user_headers(t.user)),
        "p24_log_headers": _wl(lambda t: labels.with_headers(w.worklog_page(t), labels.LOG_HEADERS)),
        "p24_user_headers": _wl(
            lambda t: labels.with_headers(directory.user_directory(t).drop("css"), labels.USER_HEADERS)
        ),
        "r14_user_wide": _wl(lambda t: matrix.user_project_hours_wide(t, 1, YEAR)),
        "r14_user_projects": _wl(lambda t: matrix.user_project_hours(t, YEAR)),
        "r15_gantt": _wl(lambda t: gantt.gantt_spans(t, YEAR), dated=True),
        "r15_gantt_current": _wl(lambda t: gantt.gantt_spans(t, YEAR, relevant=1), dated=True),
        "r16_detail": _cal(calendar.calendar_detail),
        "r16_detail_stage": _cal(lambda t: calendar.calendar_detail(t, 2024, 1, stage=STAGE_NAMES[2])),
        "r17_legend": _cal(calendar.calendar_legend),
        "r18_contiguity": _cal(calendar.contiguity, folded=True),
        "r19_grid": _cal(calendar.calendar_grid, folded=True),
        "r19_grid_plain": _cal(lambda t: calendar.calendar_grid(t, 2024, 1)),
        "r20_days": _cal(lambda t: calendar.project_days(t, CAL_TODAY)),
        "r20_dates": _wl(lambda t: calendar.date_dimension(t, dt.date(1997, 3, 9))),
        "r21_deadlines": _wl(directory.stage_deadlines),
        "r22_latest_project": _cal(directory.latest_project),
        "r23_users": _wl(directory.user_directory),
        "r24_projects": _wl(directory.project_directory, dated=True),
        "r25_lookup": _wl(_lookups),
        "r26_first_names": _wl(directory.first_name_colours),
        "r27_user_colours": _wl(lambda t: directory.user_series_colours(t, YEAR)),
        "r27_project_colours": _wl(lambda t: directory.project_series_colours(t, YEAR)),
        "m01_upsert": lambda s, d: _named(_upsert(s, d).entries),
        "m01_statuses": lambda s, d: _upsert(s, d).statuses,
        "m01_over_snapshot": lambda s, d: _named(_upsert_over(s, d).entries),
        "m02_fold": lambda s, d: _named(_mixed(s, d).entries),
        "m02_statuses": lambda s, d: _mixed(s, d).statuses,
        "m02_fold_folded": lambda s, d: _named(_mixed(s, d, folded=True).entries),
        "m02_over_snapshot": lambda s, d: _named(_mixed_over(s, d).entries),
        "m02_over_statuses": lambda s, d: _mixed_over(s, d).statuses,
        "s01_stream": _stream,
        "s01_seeded": lambda s, d: _named(edit_stream.current_entries(s, _seeded_stream(s, d))),
        "s01_statuses": lambda s, d: edit_stream.edit_statuses(s, _seeded_stream(s, d)),
        "s01_published": lambda s, d: _named(
            edit_stream.current_entries(s, _seeded_stream(s, d, batches=3))
        ),
        "p19_command_rejects": _command_rejects,
        "m03_cascade": _wl(_m03_cascade),
        "m03_insert": _m03_insert,
        "m03_update": _wl(_m03_update),
        "m03_update_rejects": _wl(_m03_update_rejects),
        "m04_update": _wl(_m04_update),
        "m05_patch_repeated": _wl(_m05_patch_repeated, dated=True),
        "m04_cascade": _wl(_m04_cascade),
        "m04_insert": _m04_insert,
        "m05_patch": _wl(_m05_patch, dated=True),
        "m06_rejects": _m06_rejects,
        "d01_audit": _wl(audit.integrity_audit),
        "d01_audit_calendar": _cal(audit.integrity_audit),
        "d01_after_edits": _audit_after,
        "i01_ingest": _ingested,
        "i01_ingest_all": _ingested_all,
        "c01_cached": _cached,
        "c01_hit": _cache_hit,
        "p04_published": _published,
        "p04_month_deleted": _published_month,
        "p48_projects_deleted": _published_cascade,
    }
