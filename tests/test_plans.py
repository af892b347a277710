"""What the plans must look like at any scale."""

import re

import pytest

from hourloom.catalogue import queries
from hourloom.operators import calendar, cards, gantt, lines, matrix, worklog
from hourloom.schema import ALL, STAGE_NAMES
from hourloom.sources import views

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def log(spark):
    return views.long_log(spark, SF)


def test_year_filters_reach_the_scan(log):
    for df in (
        lines.project_lines(log, 1997),
        matrix.stage_matrix(log, 1997, 3),
        matrix.user_project_hours(log, 1997),
        worklog.grouped_hours(log, year=1997, project=ALL),
        cards.project_cards(log, year=1997, scoped=True),
    ):
        assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate.*LessThan\(l_shipdate", plan(df))


def test_name_filters_apply_before_the_sum(log):
    text = plan(worklog.grouped_hours(log, user="Supplier#000000007", year=ALL), "simple")
    assert text.rindex("partial_sum") < text.rindex("LeftSemi")


def test_scans_read_only_what_they_use(log):
    text = plan(worklog.grouped_hours(log, year=ALL))
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert "Join" not in text
    facets = plan(worklog.filter_facets(log))
    fact = "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>"
    assert facets.count(fact) == 1 and "l_quantity" not in facets


def test_groups_are_combined_before_joins(log):
    """Below the first join there is a partial sum of the fact."""
    text = plan(worklog.grouped_hours(log, relevant=1, user=ALL, square=ALL), "simple")
    scan = text.index("FileScan parquet [l_")
    above = text[:scan]
    assert above.rindex("partial_sum") > above.rindex("Join")


ALL_FIELDS = dict.fromkeys(("year", "month", "day", "user", "project", "square", "stage"), ALL)


def test_entries_are_not_dealt_out_by_stage(spark, log):
    """A shuffle by stage alone leaves all entries in as many tasks as there are stages."""
    month = views.month_log(spark, SF)
    for df in (
        worklog.grouped_hours(log, **ALL_FIELDS),
        worklog.grouped_hours(log, stage=STAGE_NAMES[1], user=ALL),
        worklog.worklog_page(log),
        worklog.worklog_count(log),
        matrix.stage_matrix(log, 1997),
        calendar.calendar_detail(month),
        calendar.calendar_detail(month, stage=STAGE_NAMES[2]),
    ):
        text = plan(df, "simple")
        assert re.search(r"BroadcastHashJoin \[(stageId|l_linenumber)#", text)
        assert not re.search(r"hashpartitioning\((stageId|l_linenumber)#\d+, \d+\)", text)


def test_whole_days_are_summed_by_one_key(log):
    for chosen, keys in ((ALL_FIELDS, 4), ({"year": ALL, "month": ALL, "day": ALL}, 1), ({"year": ALL, "day": ALL}, 2)):
        text = plan(worklog.grouped_hours(log, **chosen), "simple")
        partial = re.search(r"keys=\[([^\]]*)\], functions=\[partial_sum", text)[1]
        assert len(partial.split(", ")) == keys


NO_WINDOW_KEYS = re.compile(r"Window \[.*\], \[\](,|$)|Window \[[^\]]*\](\)|, \[[a-z_]*#\d+ (ASC|DESC))", re.M)


@pytest.mark.parametrize(
    "name",
    [
        "r01_cards_current_year", "r09_by_all_fields", "r12_gaps", "r13_matrix_long", "r16_detail",
        "r18_contiguity", "r19_grid", "r20_days", "r21_deadlines", "r25_lookup", "r26_first_names",
        "r07_page", "r07_page_done", "r07_page_deep", "r01_cards_of_years", "r13_matrix_maps", "r15_gantt", "r27_project_colours", "m01_upsert", "m01_over_snapshot", "m03_insert", "m04_insert", "m06_rejects",
    ],
)
def test_no_cross_joins_and_no_window_over_everything(spark, name):
    text = plan(queries()[name](spark, SF), "simple")
    assert "CartesianProduct" not in text
    if "BroadcastNestedLoopJoin" in text:
        pytest.fail("nested loop join")
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            assert "windowspecdefinition(" in line
            spec = line.split("windowspecdefinition(", 1)[1]
            first = spec.split(",")[0]
            assert not re.search(r" (ASC|DESC) ", first + " "), line


def test_hot_slots_are_cut_before_the_shuffle(spark):
    for name in ("m01_upsert", "r19_grid"):
        text = plan(queries()[name](spark, SF), "simple")
        assert re.search(r"WindowGroupLimit .*row_number\(\), [23], Partial", text)


def test_gantt_positions_are_counted_by_range(spark, log):
    """No task sorts all projects: places are counted inside range partitions."""
    text = plan(gantt.gantt_spans(log, 1997), "simple")
    windows = [line for line in text.splitlines() if re.search(r"\bWindow \[", line)]
    assert windows and all(re.search(r"windowspecdefinition\(_range#", w) for w in windows)
    rows = gantt.gantt_spans(log, 1997).orderBy("pos").collect()
    names = [r.name for r in rows]
    assert names == sorted(names)
    assert [r.pos for r in rows] == [i / max(1, len(rows) - 1) for i in range(len(rows))]


def test_a_deep_page_sorts_its_days_only(spark, log):
    """No task keeps the rows before the page, and the day counts read one column."""
    text = plan(worklog.worklog_page(log, page=20_000), "simple")
    assert not re.search(r"TakeOrderedAndProject\(limit=8", text)
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(dateStamp#", text)


def test_matrix_totals_come_from_one_aggregate(spark, log):
    text = plan(matrix.stage_matrix(log, 1997), "simple")
    assert text.count("Expand [") == 1 and "Union" not in text
