import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hourloom import catalogue
from hourloom.operators import worklog
from hourloom.schema import ALL, SCHEMAS
from hourloom.sources import cache, dump, snapshots
from hourloom.sources.tables import JdbcSource, load_tables
from small import bag, edits, rows, tables

DUMP = """-- synthetic
DROP TABLE IF EXISTS `main`;
CREATE TABLE IF NOT EXISTS `main` (
  `id` int NOT NULL
) ENGINE=InnoDB;
INSERT INTO `main` (`id`, `userId`, `projectId`, `stageId`, `dateStamp`, `hours`) VALUES
\t(31, 8, 14, 2, '2031-02-28', 7),
\t(32, 9, 15, 5, '1999-12-31', 10),
\t(33, 8, 14, 3, '2028-02-29', 5);

INSERT INTO `user` (`id`, `name`, `color`, `username`, `admin`, `relevant`, `password`) VALUES
\t(1, 'O''Neil (jr), x', '0.1,0.4,0.8,1', 'oneil', 1, 1, 'secret'),
\t(2, 'back\\\\slash \\'q\\'', NULL, '', 0, 1, 'NULL');
INSERT INTO `stage` (`id`, `name`) VALUES (1, 'ONE; two'), (2, 'NULL');
INSERT INTO `project` (`id`, `name`, `square`, `level`, `startdate`, `isDone`) VALUES
\t(77, 'INSERT INTO `main`', NULL, 2, '2030-11-30', 0);
"""


def test_dump_is_read_with_quotes_nulls_and_types(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text(DUMP)
    t = dump.load_dump(spark, str(path))
    assert [f.dataType for f in t.fact.schema] == [f.dataType for f in SCHEMAS["main"]]
    assert bag(t.fact, "id", "userId", "hours") == [(31, 8, 7), (32, 9, 10), (33, 8, 5)]
    assert bag(t.user) == [
        (1, "O'Neil (jr), x", "0.1,0.4,0.8,1", "oneil", 1, 1),
        (2, "back\\slash 'q'", None, "", 0, 1),
    ]
    assert bag(t.stage) == [(1, "ONE; two"), (2, "NULL")]
    assert bag(t.project, "name", "square", "level") == [("INSERT INTO `main`", None, 2)]
    assert t.deadline.count() == 0


def test_dump_tuples_far_from_their_header(spark, tmp_path):
    """Splits that start in the middle of a statement know its table."""
    path = tmp_path / "big.sql"
    lines = ["INSERT INTO `stage` (`id`, `name`) VALUES"]
    lines += [f"\t({i}, 'stage number {i}')," for i in range(1, 4000)] + ["\t(4000, 'last');"]
    lines += ["INSERT INTO `user` (`id`, `name`) VALUES", "\t(7, 'only');"]
    path.write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
        assert rows(dump.dump_table(spark, str(path), "stage").selectExpr("count(1)", "sum(id)")) == [
            (4000, 4000 * 4001 // 2)
        ]
        assert bag(dump.dump_table(spark, str(path), "user"), "id", "name") == [(7, "only")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ingested_tables_load(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text(DUMP)
    dump.ingest_dump(spark, str(path), str(tmp_path / "tables"))
    t = load_tables(spark, str(tmp_path / "tables"))
    assert rows(t.fact.selectExpr("count(1)")) == [(3,)]
    assert "password" not in t.user.columns


def test_jdbc_reads_only_schema_columns_in_ranges():
    source = JdbcSource("jdbc:mysql://host/db", partitions=4)
    options = source.options("user", 5, 99)
    assert "password" not in options["dbtable"] and "username" in options["dbtable"]
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4"
    assert (options["lowerBound"], options["upperBound"]) == ("5", "100")
    assert source.options("projectstage", 0, 1)["partitionColumn"] == "projectId"
    assert "min(projectId)" in source.bounds_options("projectstage")["dbtable"]


def test_edits_write_the_touched_years_only(spark, tmp_path):
    before, after = str(tmp_path / "before"), str(tmp_path / "after")
    log = [(1, 1, 1, 1, "2023-05-01", 4), (2, 1, 1, 1, "2024-01-10", 3), (7, 2, 1, 1, "2022-01-10", 3)]
    snapshots.save_entries(tables(spark, log).fact, before)
    years = snapshots.year_folders(spark, before)
    assert sorted(years.folders) == [2022, 2023, 2024] and years.next_id == 8
    batch = edits(
        spark,
        [(1, "delete", 1, 1, 1, "2024-01-10", 1), (2, "set", 2, 1, 1, "2025-02-02", 6), (3, "set", 2, 1, 1, "2023-05-01", 5)],
    )
    done = snapshots.publish_edits(spark, years, after, batch)
    # 2024 lost its only entry, 2022 was not asked for.
    assert done.years.folders == {
        2022: f"{before}/year=2022", 2023: f"{after}/year=2023", 2025: f"{after}/year=2025"
    }
    assert bag(done.years.entries(spark), "id", "userId", "hours") == [(1, 1, 4), (10, 2, 5), (7, 2, 3), (9, 2, 6)]
    assert done.years.next_id == 11
    assert bag(done.statuses) == [(1, "deleted"), (2, "saved"), (3, "saved")]
    assert years.entries(spark).count() == 3
    with pytest.raises(AnalysisException):
        snapshots.save_entries(tables(spark, log).fact, after)
    nothing = snapshots.publish_edits(spark, years, str(tmp_path / "same"), edits(spark, []))
    assert nothing.years == years


def test_a_cascade_writes_the_touched_years_only(spark, tmp_path):
    log = [(1, 1, 1, 1, "2023-05-01", 4), (2, 2, 1, 1, "2024-01-10", 3), (3, 2, 2, 1, "2022-01-10", 3)]
    snapshots.save_entries(tables(spark, log).fact, str(tmp_path / "before"))
    years = snapshots.year_folders(spark, str(tmp_path / "before"))
    gone = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    after = snapshots.publish_without(spark, years, str(tmp_path / "after"), gone, "projectId")
    assert after.folders == {2022: years.folders[2022]}
    assert bag(after.entries(spark), "id") == [(3,)]


def test_report_is_built_once_per_content(spark, tmp_path):
    log = [(1, 1, 1, 1, "2023-05-01", 4), (2, 2, 1, 1, "2023-05-01", 4)]
    built = []

    def ask(t):
        build = lambda: built.append(1) or worklog.grouped_hours(t, year=ALL)
        found = cache.materialised(spark, str(tmp_path), "grouped", {"year": ALL}, cache.data_version(t), build)
        return rows(found)

    assert ask(tables(spark, log)) == [(2023, 8)]
    assert ask(tables(spark, log[::-1])) == [(2023, 8)] and len(built) == 1
    assert ask(tables(spark, [log[0], (2, 2, 1, 1, "2023-05-01", 5)])) == [(2023, 9)]
    assert ask(tables(spark, [*log, log[0]])) == [(2023, 12)] and len(built) == 3
    assert not cache.is_written(spark, cache.report_path(str(tmp_path), "grouped", {"year": 1}, "1"))


def test_an_unfinished_report_is_replaced(spark, tmp_path):
    t = tables(spark, [(1, 1, 1, 1, "2023-05-01", 4)])
    path = cache.report_path(str(tmp_path), "grouped", {}, "v")
    spark.range(3).write.parquet(f"{path}/rows")
    found = cache.materialised(spark, str(tmp_path), "grouped", {}, "v", lambda: worklog.grouped_hours(t, year=ALL))
    assert rows(found) == [(2023, 4)]


def test_fingerprint_knows_the_columns(spark):
    one, other = spark.range(3), spark.range(3).withColumnRenamed("id", "x")
    assert cache.fingerprint(one) != cache.fingerprint(other)
    assert cache.fingerprint(one) == cache.fingerprint(one.repartition(5))
    assert cache.fingerprint(one.limit(0)) != cache.fingerprint(one)


def test_dump_lines_are_neither_moved_nor_sorted(spark, tmp_path):
    """Memory of a task must not follow the length of the text in its split."""
    path = tmp_path / "dump.sql"
    path.write_text(DUMP)
    plan = dump.statement_lines(spark, str(path))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan
    # The one window is over one row per split.
    assert plan.count("Window ") == 1 and "_left_open" in plan.split("Window ")[1].split("\n")[0]


def test_dump_split_with_several_statements_and_text_between(spark, tmp_path):
    """Lines after an ended statement belong to none, in this split and in the next one."""
    path = tmp_path / "mixed.sql"
    lines = []
    for n in range(300):
        lines += ["INSERT INTO `stage` (`id`, `name`) VALUES", f"\t({n}, 'a'),", f"\t({n + 1000}, 'b');"]
        lines += [f"\t({n + 5000}, 'no statement')", f"INSERT INTO `stage` (`id`, `name`) VALUES ({n + 9000}, 'c');"]
    path.write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = bag(dump.dump_table(spark, str(path), "stage"), "id")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == sorted([(n + k,) for n in range(300) for k in (0, 1000, 9000)], key=lambda r: str(r))


def test_dump_text_is_built_without_collecting_groups(spark):
    users = tables(spark).user
    text = catalogue._statements("user", users)
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Sort" not in plan
    many = spark.range(1, 1201, numPartitions=1).selectExpr("CAST(id AS INT) AS id", "concat('it''s ', id) AS name")
    texts = [r.value for r in catalogue._statements("stage", many).collect()]
    assert [t.count("\n\t(") for t in texts] == [500, 500, 200]
    assert all(t.startswith("INSERT INTO `stage` (`id`, `name`) VALUES\n\t(") and t.endswith(");\n") for t in texts)
