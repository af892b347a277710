import datetime as dt
import random
from collections import defaultdict

from hourloom.operators import calendar
from hourloom.schema import GRID_HOURS, STAGE_NAMES
from small import bag, rows, tables


def flags(df):
    return {r[:4]: r[4:] for r in rows(df, "user_id", "stage_id", "date", "hours", "left_f", "right_f")}


def test_neighbour_across_month_end(spark):
    t = tables(spark, [(1, 1, 1, 1, "2024-01-31", 4), (2, 1, 1, 1, "2024-02-01", 4)])
    found = flags(calendar.contiguity(t))
    assert found[(1, 1, dt.date(2024, 1, 31), 4)] == (0, 1)
    assert found[(1, 1, dt.date(2024, 2, 1), 4)] == (1, 0)
    # The neighbour counts even when the period asked for does not hold it.
    assert flags(calendar.contiguity(t, 2024, 2)) == {(1, 1, dt.date(2024, 2, 1), 4): (1, 0)}
    assert flags(calendar.contiguity(t, None, 1)) == {(1, 1, dt.date(2024, 1, 31), 4): (0, 1)}


def test_lower_neighbour(spark):
    t = tables(spark, [(1, 1, 1, 1, "2024-01-10", 8), (2, 1, 1, 1, "2024-01-11", 4)])
    found = flags(calendar.contiguity(t))
    assert found[(1, 1, dt.date(2024, 1, 10), 8)] == (0, 0)
    assert found[(1, 1, dt.date(2024, 1, 11), 4)] == (1, 0)


def expected_grid(log):
    """The grid of one project and month, cell by cell."""
    per_cell = defaultdict(list)
    best = defaultdict(int)
    for _, u, _, s, d, h in log:
        per_cell[(s, int(d[-2:]))].append((u, -h))
        best[(u, s, int(d[-2:]))] = max(best[(u, s, int(d[-2:]))], h)
    out = {}
    for s in range(1, 7):
        for day in range(1, 32):
            for hour in range(1, GRID_HOURS + 1):
                shown = [(u, -h) for u, h in sorted(per_cell[(s, day)]) if -h >= hour][:2]
                top = bool(shown) and all(h == hour for _, h in shown)
                left = right = 0
                if top and len(shown) == 1:
                    u = shown[0][0]
                    left, right = (int(best[(u, s, day + step)] >= hour) for step in (-1, 1))
                users = [u for u, _ in shown] + [None, None]
                out[(s, day, hour)] = (len(shown), users[0], users[1], int(top), left, right)
    return out


def test_grid_against_cell_by_cell_reading(spark):
    rng = random.Random(7)
    log = [
        (i, rng.randint(1, 3), 1, rng.randint(1, 6), f"2024-01-{rng.randint(1, 31):02d}", rng.randint(1, 14))
        for i in range(1, 400)
    ]
    grid = calendar.calendar_grid(tables(spark, log))
    found = {r[:3]: r[3:] for r in rows(grid, "stage_id", "day", "hour", "n", "u1", "u2", "is_top", "left_f", "right_f")}
    assert found == expected_grid(log)


def test_grid_days_and_stage_filter(spark):
    t = tables(spark, [(1, 1, 1, 2, "2023-02-10", 3)])
    grid = calendar.calendar_grid(t, 2023, 2, 1, stage=STAGE_NAMES[1])
    assert grid.count() == 28 * 12
    assert bag(grid.filter("n > 0"), "day", "hour", "is_top") == [(10, 1, 0), (10, 2, 0), (10, 3, 1)]


def test_grid_gives_back_the_entries(spark):
    """Single entries and people of the grid are those of the detail."""
    log = [(1, 1, 1, 1, "2024-01-02", 3), (2, 2, 1, 1, "2024-01-02", 5), (3, 1, 1, 4, "2024-01-03", 2)]
    t = tables(spark, log)
    tops = bag(calendar.calendar_grid(t).filter("is_top = 1"), "stage_id", "day", "u1", "hour")
    assert tops == [(1, 2, 2, 5), (4, 3, 1, 2)]
    detail = calendar.calendar_detail(t, 2024, 1, 1)
    assert rows(detail, "stage_id", "user_id", "day", "hours", "color") == [
        (1, 1, 2, 3, "#e64c80"), (1, 2, 2, 5, "#808080"), (4, 1, 3, 2, "#e64c80"),
    ]
    assert bag(calendar.calendar_legend(t), "user_id", "name") == [(1, "Ann Lee"), (2, "Bob")]
    assert calendar.calendar_detail(t, stage=STAGE_NAMES[3]).count() == 1


def test_day_rows(spark):
    t = tables(spark, [(1, 1, 1, 1, "2024-02-10", 3)])
    days = rows(calendar.project_days(t, dt.date(2024, 2, 29)))
    assert len(days) == 29 and sum(r[-1] for r in days) == 1
    assert sum(r[-2] for r in days) == 8
    span = tables(spark, [(1, 1, 1, 1, "2024-02-10", 3), (2, 1, 1, 1, "2024-04-01", 3)])
    assert calendar.date_dimension(span, dt.date(2024, 1, 1)).count() == 29 + 31 + 30
    assert calendar.date_dimension(tables(spark, []), dt.date(2024, 1, 1)).count() == 0
