import pytest

from hourloom.operators import cards, directory, gantt, lines, matrix, worklog
from hourloom.schema import ALL, ARCHIVED, CURRENT, STAGE_NAMES, TOTAL
from small import bag, projects, rows, stages, tables, users

LOG = [
    (1, 1, 1, 1, "2023-05-01", 4),
    (2, 1, 1, 1, "2024-01-10", 3),
    (3, 2, 1, 2, "2024-01-11", 5),
    (4, 2, 2, 2, "2023-02-01", 8),
    (5, 1, 1, 1, "2024-03-10", 2),
]


def test_project_without_logs_has_no_totals(spark):
    found = {r[0]: r[1:] for r in rows(cards.project_cards(tables(spark, LOG)), "id", "count_users", "sum_hours")}
    assert found == {1: (2, 14), 2: (1, 8), 3: (None, None)}


def test_cards_year_picks_projects_but_keeps_totals(spark):
    t = tables(spark, LOG)
    assert rows(cards.project_cards(t, year=2024), "id", "sum_hours") == [(1, 14)]
    assert rows(cards.project_cards(t, year=2024, scoped=True), "id", "sum_hours") == [(1, 10)]


def test_cards_relevance_and_order(spark):
    t = tables(spark, LOG)
    assert [r[0] for r in rows(cards.project_cards(t), "id")] == [1, 3, 2]
    assert rows(cards.project_cards(t, ARCHIVED), "id") == [(2,)]
    assert rows(cards.project_cards(t, CURRENT), "id") == [(1,), (3,)]
    with pytest.raises(ValueError):
        cards.project_cards(t, "other")


def test_status_counts(spark):
    t = tables(spark, LOG)
    assert bag(cards.status_counts(t)) == [(0, 2), (1, 1)]
    assert rows(cards.count_projects(t, 1)) == [(2,)]
    assert bag(cards.user_status_counts(t)) == [(1, 0, 1), (2, 0, 1), (2, 1, 1)]
    assert rows(cards.count_projects_of(t, 3)) == [(0,)]
    assert rows(cards.count_projects_of(t, 2, excluded=0)) == [(1,)]


@pytest.mark.parametrize("relevant, n", [(None, 5), (1, 4), (0, 1)])
def test_page_count_and_grouping_agree_on_relevance(spark, relevant, n):
    t = tables(spark, LOG)
    assert worklog.worklog_count(t, relevant).first()[0] == n
    assert worklog.worklog_page(t, relevant=relevant).count() == n
    total = sum(r[-1] for r in rows(worklog.grouped_hours(t, relevant, year=ALL)))
    assert total == sum(r[-1] for r in rows(worklog.worklog_page(t, relevant=relevant), "hours"))


def test_pages_tile_the_log(spark):
    log = [(i, 1 + i % 2, 1 + i % 2, 1 + i % 6, f"2024-01-{1 + i % 7:02d}", 1 + i % 9) for i in range(1, 60)]
    t = tables(spark, log)
    pages = [rows(worklog.worklog_page(t, page=p, size=7), "id") for p in range(10)]
    seen = [r[0] for page in pages for r in page]
    assert seen == [r[0] for r in sorted(log, key=lambda r: (-int(r[4][-2:]), r[0]))]
    assert pages[9] == []


def test_pages_leave_orphans_out_and_stay_full(spark):
    log = [(1, 1, 1, 1, "2024-01-03", 1), (2, 99, 1, 1, "2024-01-02", 1), (3, 1, 99, 1, "2024-01-02", 1), (4, 1, 1, 2, "2024-01-01", 1)]
    log += [(5, 1, 1, 9, "2024-01-05", 1)]
    t = tables(spark, log)
    assert [r[0] for r in rows(worklog.worklog_page(t, size=2), "id")] == [1, 4]
    assert rows(worklog.worklog_count(t)) == [(2,)]


def test_deep_page_in_a_crowded_day(spark):
    log = [(3 * i, 1, 1, 1, "2024-01-01", 1) for i in range(1, 300)]
    log += [(10_000 + i, 1, 1, 1, "2023-12-31", 1) for i in range(20)]
    t = tables(spark, log)
    order = [r[0] for r in log]
    for page in (0, 3, 42, 44):
        found = [r[0] for r in rows(worklog.worklog_page(t, page=page, size=7), "id")]
        assert found == order[page * 7 : page * 7 + 7]


def test_keyset_page_follows_the_last_row(spark):
    import datetime as dt

    t = tables(spark, LOG)
    after = worklog.worklog_after(t, {"dateStamp": dt.date(2024, 1, 11), "id": 3}, size=2)
    assert [r[0] for r in rows(after, "id")] == [2, 1]


def test_every_grouping_keeps_the_total(spark):
    t = tables(spark, LOG)
    for chosen in [
        {"year": ALL},
        {"year": ALL, "month": ALL, "day": ALL},
        {"user": ALL},
        {"project": ALL},
        {"square": ALL},
        {"stage": ALL},
        {"user": ALL, "square": ALL, "stage": ALL},
    ]:
        assert sum(r[-1] for r in rows(worklog.grouped_hours(t, **chosen))) == 22


def test_grouping_columns_order_and_filters(spark):
    t = tables(spark, LOG)
    df = worklog.grouped_hours(t, user="Ann Lee", year=ALL, stage=ALL)
    assert df.columns == ["year", "user", "stage", "hours"]
    assert rows(df) == [(2024, "Ann Lee", STAGE_NAMES[0], 5), (2023, "Ann Lee", STAGE_NAMES[0], 4)]
    assert rows(worklog.grouped_hours(t, month=1, user=ALL), "user", "hours") == [("Bob", 5), ("Ann Lee", 3)]
    assert worklog.grouped_hours(t).columns[:3] == ["year", "month", "day"]
    with pytest.raises(ValueError):
        worklog.grouped_hours(t, month=13)
    with pytest.raises(ValueError):
        worklog.grouped_hours(t, floor=1)


def test_all_fields_are_grouped_by_whole_days(spark):
    log = [
        *LOG,
        (6, 1, 1, 1, "2024-01-10", 6),
        (7, 1, 1, 7, "2024-01-10", 1),
        (8, 9, 1, 1, "2024-01-10", 1),
        (9, 1, 1, 1, "2024-02-29", 7),
        (10, 1, 1, 1, "2023-02-01", 7),
    ]
    every = dict.fromkeys(("year", "month", "day", "user", "project", "square", "stage"), ALL)
    first, second = STAGE_NAMES[:2]
    found = worklog.grouped_hours(tables(spark, log), **every)
    assert found.columns == [*every, "hours"]
    assert rows(found) == [
        (2024, 3, 10, "Ann Lee", "Дом", 50, first, 2),
        (2024, 2, 29, "Ann Lee", "Дом", 50, first, 7),
        (2024, 1, 11, "Bob", "Дом", 50, second, 5),
        (2024, 1, 10, "Ann Lee", "Дом", 50, first, 9),
        (2023, 5, 1, "Ann Lee", "Дом", 50, first, 4),
        (2023, 2, 1, "Bob", "Офис", 80, second, 8),
        (2023, 2, 1, "Ann Lee", "Дом", 50, first, 7),
    ]
    fixed = worklog.grouped_hours(tables(spark, log), year=2024, month=1, day=10, stage=first)
    assert rows(fixed) == [(2024, 1, 10, first, 10)]


def test_same_names_stay_apart_unless_merged(spark):
    t = tables(
        spark,
        [(1, 1, 1, 1, "2024-01-01", 2), (2, 2, 1, 1, "2024-01-01", 3)],
        user=users(spark, [(1, "Anna", None), (2, "ánna", None)]),
    )
    assert bag(worklog.grouped_hours(t, user=ALL), "hours") == [(2,), (3,)]
    assert bag(worklog.grouped_hours(t, user=ALL, merge_names=True), "hours") == [(5,)]
    assert bag(worklog.grouped_hours(t, user="ANNA", merge_names=True), "hours") == [(5,)]


def test_all_people_of_a_name_count(spark):
    t = tables(
        spark,
        [(i, i, 1, 1, "2024-01-01", i) for i in (1, 2, 3)],
        user=users(spark, [(1, "Max", None), (2, "Max", None), (3, "Eva", None)]),
    )
    assert bag(worklog.grouped_hours(t, user="Max"), "hours") == [(1,), (2,)]


def test_facets(spark):
    import datetime as dt

    t = tables(spark, LOG)
    facets = bag(worklog.filter_facets(t))
    assert ("month", "1", "01") in facets and ("project", "Дом", "Дом") in facets
    assert not [f for f in facets if f[1] == "Пустой"]
    chart = bag(worklog.chart_facets(t, dt.date(2026, 1, 1)))
    assert [f[1] for f in chart if f[0] == "year"] == ["2023", "2024", "2025", "2026"]
    assert ("project", "3", "Пустой") in chart and ("month", "5", "Май") in chart
    assert rows(worklog.active_years(t)) == [(2024,), (2023,)]


def test_break_only_where_more_than_one_step_is_missing(spark):
    t = tables(spark, [(i, 1, 1, 1, f"2024-0{m}-01", m) for i, m in enumerate((1, 2, 5), 1)])
    broken = lines.with_breaks(lines.project_lines(t, 2024), ["project_id", "user_id"])
    assert sorted(rows(broken, "seq", "x", "hours")) == [(1, 1, 1), (2, 2, 2), (3, None, None), (4, 5, 5)]


def test_lines_keep_same_named_people_apart(spark):
    t = tables(
        spark,
        [(1, 1, 1, 1, "2024-01-01", 2), (2, 2, 1, 1, "2024-01-01", 3)],
        user=users(spark, [(1, "Max", "0,0,0,1"), (2, "Max", "1,1,1,1")]),
    )
    assert bag(lines.project_lines(t, 2024, 1), "user_id", "x", "hours") == [(1, 1, 2), (2, 1, 3)]
    assert bag(lines.user_lines(t, 2024, user_id=2), "project_id", "x", "hours") == [(1, 1, 3)]


def test_matrix_drops_unknown_stages_before_totals(spark):
    log = [(1, 1, 1, 1, "2024-01-01", 4), (2, 2, 1, 7, "2024-01-01", 9), (3, 1, 1, 3, "2024-02-01", 1)]
    t = tables(spark, log)
    cells = {(r[0], r[1]): r[2] for r in rows(matrix.stage_matrix(t, 2024), "stage", "user", "hours")}
    assert cells[(TOTAL, TOTAL)] == 5 and cells[(STAGE_NAMES[1], "Ann Lee")] == 0
    assert ("Bob" in {u for _, u in cells}) is False
    # A stage that is stored but not listed leaves its people in, with zeros.
    t = tables(spark, log, stage=stages(spark, [(7, "ДРУГОЕ")]))
    cells = {(r[0], r[1]): r[2] for r in rows(matrix.stage_matrix(t, 2024), "stage", "user", "hours")}
    assert cells[(TOTAL, "Bob")] == 0 and cells[(TOTAL, TOTAL)] == 5
    assert rows(matrix.stage_matrix(t, 2020)) == []


def test_wide_matrix(spark):
    t = tables(spark, LOG)
    wide = matrix.stage_matrix_wide(t, 1, 2024)
    assert wide.columns == ["project_id", "stage", "Ann Lee", "Bob", TOTAL]
    assert [r[1] for r in rows(wide)] == [*STAGE_NAMES, TOTAL]
    assert rows(wide)[-1] == (1, TOTAL, 5, 5, 10)
    assert matrix.matrix_headers(wide) == {"Ann Lee": "Ann", "Bob": "Bob", TOTAL: TOTAL}


def test_wide_user_hours_cut_headers(spark):
    long_names = projects(spark, [(1, "П" * 35 + "а", 1, 1, 0), (2, "П" * 35 + "б", 1, 1, 0)])
    t = tables(spark, LOG, project=long_names)
    more = [*LOG, (90, 1, 2, 1, "2023-06-01", 3)]
    wide = matrix.user_project_hours_wide(tables(spark, more, project=long_names), 1, 2023)
    assert wide.columns == ["user_id", "П" * 30, "П" * 30 + " (2)"]
    assert bag(wide) == [(1, 4, 3)]
    assert bag(matrix.user_project_hours_wide(t, 2, 2023)) == [(2, 8)]
    assert rows(matrix.user_project_hours_wide(t, 1, 2020)) == []


def test_gantt(spark):
    t = tables(spark, LOG)
    assert bag(gantt.gantt_spans(t, 2024)) == [("Дом", 1, 3, 2.0, 0.0)]
    assert bag(gantt.gantt_spans(t, 2023)) == [("Дом", 5, 5, 0.2, 0.0), ("Офис", 2, 2, 0.2, 1.0)]
    assert bag(gantt.gantt_spans(t, 2023, relevant=0), "name", "pos") == [("Офис", 0.0)]


def test_missing_deadline_shifts_no_other(spark):
    t = tables(spark, deadline=[(1, s, f"2024-01-0{s}") for s in (1, 2, 4, 5, 6)])
    found = {r[0]: r[1] for r in rows(directory.stage_deadlines(t).filter("project_id = 1"), "stage_id", "finish_date")}
    assert found[3] is None and str(found[4]) == "2024-01-04" and len(found) == 6


def test_directories_and_colours(spark):
    t = tables(spark, LOG + [(9, 3, 2, 1, "2020-01-01", 1)])
    assert rows(directory.user_directory(t), "css", "admin", "status")[2] == ("rgba(47, 47, 47, 1)", "Нет", "Актуальный")
    assert rows(directory.project_directory(t), "id", "status")[1] == (2, "Не актуальный")
    assert bag(directory.latest_project(t)) == [(1, 1), (2, 2), (3, 2)]
    assert bag(directory.first_name_colours(t)) == [(1, "", "#808080"), (1, "Ann", "#e64c80"), (2, "", "#808080")]
    assert (2, 3, "Cy Dent", "#000000") in bag(directory.user_series_colours(t))
    assert bag(directory.project_series_colours(t)) == [
        (1, 1, "Дом", "#66C2A5"), (2, 1, "Дом", "#66C2A5"), (2, 2, "Офис", "#FC8D62"), (3, 2, "Офис", "#66C2A5"),
    ]


def test_lookups_treat_wildcards_as_text(spark):
    t = tables(spark)
    asked = spark.createDataFrame([("%",), ("LOGIN1",), ("LOGIN1",)], "login string")
    assert bag(directory.users_by_login(t, asked), "login", "id") == [("LOGIN1", 1)]
    names = spark.createDataFrame([("ann lee",), ("A%",)], "name string")
    assert bag(directory.logins_by_name(t, names)) == [("ann lee", 1, "login1")]
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    assert bag(directory.user_names_by_id(t, ids)) == [(2, "Bob")]
    assert bag(directory.logins_by_id(t, ids)) == [(2, "login2")]
    assert bag(directory.project_names_by_id(t, ids)) == [(2, "Офис")]


def test_shown_headers(spark):
    from hourloom.functions.labels import LOG_HEADERS, USER_HEADERS, with_headers

    t = tables(spark, LOG)
    shown = with_headers(worklog.grouped_hours(t, year=ALL, square=ALL), LOG_HEADERS)
    assert shown.columns == ["ГОД", "м²", "ЧАСЫ"]
    assert with_headers(directory.user_directory(t), USER_HEADERS).columns[:3] == ["id", "ИМЯ", "ЛОГИН"]


def test_yearly_summary_is_small_and_merges(spark):
    """Rows of a summary have a fixed width: sums need no sort of wide bitmaps."""
    people = [0, 1, 63, 64, 127, 128, 40_000, -1, -64, 1]
    fact = [(i, u, 1, 1, f"{1996 + i % 3}-05-05", 2) for i, u in enumerate(people)]
    fact += [(100 + i, u, 2, 1, "1997-02-02", 1) for i, u in enumerate([5, 5, 70])]
    t = tables(spark, fact)
    summary = cards.yearly_summary(t.fact)
    assert dict(summary.dtypes)["people"] == "bigint"
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    found = {r.id: (r.count_users, r.sum_hours) for r in cards.cards_of_years(t, summary, 1996, 1998).collect()}
    assert found == {1: (9, 20), 2: (2, 3)}
    one = {r.id: r.count_users for r in cards.cards_of_years(t, summary, 1997, 1997).collect()}
    assert one == {1: 3, 2: 2}
