"""Work log: facets, pages, counts and hours grouped by any fields."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.dates import month_name, two_digits
from hourloom.functions.text import NAME_COLLATION
from hourloom.plans.joins import listed
from hourloom.plans.paging import after_key, first_rows, newest_first, page_days, placed
from hourloom.plans.periods import check_period, in_period
from hourloom.plans.predicates import all_of, relevance
from hourloom.schema import ALL, PAGE_SIZE, Tables

# ---------------------------------------------------------------- facets


def active_years(t: Tables) -> DataFrame:
    """Years with entries, newest first."""
    return t.fact.select(F.year("dateStamp").alias("year")).distinct().orderBy(F.desc("year"))


def _seen(t: Tables, dim: DataFrame, key: str) -> DataFrame:
    """Dimension rows with at least one entry. Reads one column of the fact."""
    used = t.fact.select(F.col(key).alias("_used")).distinct()
    return dim.join(used, F.col("id") == F.col("_used"), "left_semi")


def _facet(facet: str, rows: DataFrame, value: Column, label: Column) -> DataFrame:
    return rows.select(
        F.lit(facet).alias("facet"),
        value.cast("string").alias("value"),
        label.cast("string").alias("label"),
    ).distinct()


def filter_facets(t: Tables) -> DataFrame:
    """Values the work log can be filtered by, as (facet, value, label).

    The fact is scanned once: each row gives its day, user, project and stage as keys, and a
    distinct with partial results leaves one row per key. Names are joined to those.
    """
    keys = F.array(
        F.struct(F.lit("day").alias("kind"), F.unix_date("dateStamp").cast("long").alias("key")),
        *[
            F.struct(F.lit(d).alias("kind"), F.col(k).cast("long").alias("key"))
            for d, k in (("user", "userId"), ("project", "projectId"), ("stage", "stageId"))
        ],
    )
    seen = t.fact.select(F.inline(keys)).distinct()
    names = (
        t.user.select(F.lit("user").alias("kind"), F.col("id").alias("key"), "name", F.lit(None).cast("int").alias("square"))
        .unionByName(t.project.select(F.lit("project").alias("kind"), F.col("id").alias("key"), "name", "square"))
        .unionByName(
            t.stage.select(
                F.lit("stage").alias("kind"), F.col("id").cast("long").alias("key"), "name",
                F.lit(None).cast("int").alias("square"),
            )
        )
    )
    found = seen.join(names, ["kind", "key"], "left")
    day = F.date_from_unix_date(F.col("key").cast("int"))
    parts = (F.year(day), F.month(day), F.dayofmonth(day))
    cell = lambda facet, value, label: F.struct(
        F.lit(facet).alias("facet"),
        value.cast("string").alias("value"),
        label.cast("string").alias("label"),
    )
    is_known = F.col("name").isNotNull()
    cells = (
        F.when(
            F.col("kind") == "day",
            F.array(
                cell("year", parts[0], parts[0]),
                cell("month", parts[1], two_digits(parts[1])),
                cell("day", parts[2], two_digits(parts[2])),
            ),
        )
        .when(
            (F.col("kind") == "project") & is_known,
            F.array(
                cell("project", F.col("name"), F.col("name")),
                cell("square", F.col("square"), F.col("square")),
            ),
        )
        .when(
            is_known,
            F.array(
                F.struct(
                    F.col("kind").alias("facet"),
                    F.col("name").alias("value"),
                    F.col("name").alias("label"),
                )
            ),
        )
    )
    return found.select(F.inline(cells)).distinct()


def chart_facets(t: Tables, today: dt.date) -> DataFrame:
    """Values the charts can be filtered by: all years from today's down to the first one,
    months seen, users seen, and every project."""
    first = t.fact.agg(F.year(F.min("dateStamp")).alias("first"))
    this_year = F.lit(today.year)
    years = first.filter(F.col("first") <= this_year).select(
        F.explode(F.sequence(this_year, F.col("first"), F.lit(-1))).alias("y")
    )
    months = t.fact.select(F.month("dateStamp").alias("m")).distinct()
    users = _seen(t, t.user, "userId")
    return (
        _facet("year", years, F.col("y"), F.col("y"))
        .unionByName(_facet("month", months, F.col("m"), month_name(F.col("m"))))
        .unionByName(_facet("user", users, F.col("id"), F.col("name")))
        .unionByName(_facet("project", t.project, F.col("id"), F.col("name")))
    )


# ---------------------------------------------------------------- pages and counts


def _known(t: Tables, relevant: bool | int | None = None) -> DataFrame:
    """Entries a page may show: of a known user, project and stage, and a relevant project."""
    projects = t.project if relevant is None else t.project.filter(relevance(relevant))
    rows = t.fact
    for dim, key in ((listed(t.stage), "stageId"), (t.user, "userId"), (projects, "projectId")):
        rows = rows.join(dim.select(F.col("id").alias(key)), key, "left_semi")
    return rows


def _described(t: Tables, rows: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    """Names for the rows of one page. The page is bounded by its size, so it is the side
    that is broadcast, whatever the size of the dimensions."""
    extra = [c for c in ties if c != "hours"]
    named = rows
    for dim, key, columns in (
        (t.user, "userId", [F.col("name").alias("user")]),
        (t.project, "projectId", [F.col("name").alias("project"), F.col("square")]),
        (t.stage, "stageId", [F.col("name").alias("stage")]),
    ):
        side = dim.select(F.col("id").alias("_key"), *columns)
        named = side.join(F.broadcast(named), F.col("_key") == F.col(key)).drop("_key")
    return named.orderBy(*newest_first("dateStamp", ties)).select(
        F.year("dateStamp").alias("year"),
        F.month("dateStamp").alias("month"),
        F.dayofmonth("dateStamp").alias("day"),
        "user",
        "project",
        "stage",
        "square",
        "hours",
        *extra,
    )


def worklog_page(
    t: Tables, page: int = 0, size: int = PAGE_SIZE, relevant: bool | int | None = None
) -> DataFrame:
    """One page of the work log, newest day first, ties in `t.tie_keys` order.

    Entries of unknown users, projects or stages are left out before the page is cut, so a
    page is full as long as there are entries; names are joined to the page alone. Counts
    per day tell which days a page lies in, and only their entries are ranked, each day on
    its own; pages of all depths go the same way.
    """
    offset = page * size
    days = page_days(_known(t, relevant), "dateStamp", offset, size)
    fact = t.fact.join(F.broadcast(days), "dateStamp")
    cut = placed(_known(replace(t, fact=fact), relevant), "dateStamp", t.tie_keys, offset, size)
    return _described(t, cut, t.tie_keys)


def worklog_after(
    t: Tables, last: dict, size: int = PAGE_SIZE, relevant: bool | int | None = None
) -> DataFrame:
    """The page that follows the row with the key values `last` (dateStamp and tie keys)."""
    older = _known(t, relevant).filter(after_key("dateStamp", t.tie_keys, last))
    return _described(t, first_rows(older, "dateStamp", t.tie_keys, size), t.tie_keys)


def worklog_count(t: Tables, relevant: bool | int | None = None) -> DataFrame:
    """Number of entries the pages show, optionally of current or finished projects only.
    Counted per key before the dimensions are joined."""
    per_key = t.fact.groupBy("stageId", "userId", "projectId").agg(F.count(F.lit(1)).alias("n"))
    known = _known(replace(t, fact=per_key), relevant)
    return known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


# ---------------------------------------------------------------- grouped hours


@dataclass(frozen=True)
class Field:
    """A field hours can be grouped by.

    `source` is its column on the fact (an expression or the key of `dim`); `attribute` is
    the dimension column shown, None for date parts.
    """

    source: Column
    dim: str | None = None
    attribute: str | None = None


def _fields() -> dict[str, Field]:
    """In output order."""
    return {
        "year": Field(F.year("dateStamp")),
        "month": Field(F.month("dateStamp")),
        "day": Field(F.dayofmonth("dateStamp")),
        "user": Field(F.col("userId"), "user", "name"),
        "project": Field(F.col("projectId"), "project", "name"),
        "square": Field(F.col("projectId"), "project", "square"),
        "stage": Field(F.col("stageId"), "stage", "name"),
    }


_KEYS = {"user": "userId", "project": "projectId", "stage": "stageId"}


def grouped_hours(
    t: Tables,
    relevant: bool | int | None = None,
    merge_names: bool = False,
    page: int = 0,
    **chosen,
) -> DataFrame:
    """Hours summed by any of year, month, day, user, project, square, stage.

    Each field is ALL (group by it) or a value (keep that value and group by it); a field
    left out is not used. Without any field the paged log is returned. Same-named people or
    projects stay apart unless `merge_names`, which also compares names blind to case and
    accents.

    Entries are summed by key before any dimension is joined, so a join sees one row per
    group however many entries a hot key has; a dimension is joined once, and only if used.
    Year, month and day together are one date until the sum is done.
    """
    fields = _fields()
    unknown = set(chosen) - set(fields)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}; known: {list(fields)}")
    used = {k: chosen[k] for k in fields if chosen.get(k) is not None}
    if not used:
        return worklog_page(t, page=page, relevant=relevant)
    fixed = {k: v for k, v in used.items() if v != ALL}
    check_period(fixed.get("year"), fixed.get("month"))

    scan = [in_period(F.col("dateStamp"), fixed.get("year"), fixed.get("month"))]
    if "day" in fixed:
        scan.append(F.dayofmonth("dateStamp") == fixed["day"])
    asked = {fields[k].dim for k in used} | ({"project"} if relevant is not None else set())
    dims = [d for d in _KEYS if d in asked]
    dim_filters = {d: _dim_filter(d, fields, fixed, relevant, merge_names) for d in dims}
    # A chosen name keeps its own entries before they are summed.
    entries = t.fact.filter(all_of(scan))
    for d in dims:
        if any(fields[k].dim == d for k in fixed):
            keys = _dim(t, d).filter(dim_filters[d]).select(F.col("id").alias(_KEYS[d]))
            entries = entries.join(keys, _KEYS[d], "left_semi")

    date_parts = {k: f.source for k, f in fields.items() if k in used and f.dim is None}
    by_date = len(date_parts) == 3
    days = [F.col("dateStamp")] if by_date else [part.alias(k) for k, part in date_parts.items()]
    summed = (
        entries.groupBy(*days, *[_KEYS[d] for d in dims])
        .agg(F.sum(F.col("hours").cast("int")).alias("hours"))
    )
    if by_date:
        summed = summed.withColumns(date_parts)
    for d in dims:
        columns = [F.col("id").alias(f"_{d}")]
        columns += [
            F.col(fields[k].attribute).alias(k) for k in used if fields[k].dim == d
        ]
        side = _dim(t, d).filter(dim_filters[d]).select(*columns)
        summed = summed.join(side, F.col(_KEYS[d]) == F.col(f"_{d}"))

    out = list(used)
    apart = [_KEYS[d] for d in ("user", "project") if d in used and not merge_names]
    by = [_merged(k, fields, merge_names) for k in out]
    if _needs_second_sum(used, relevant, merge_names):
        summed = summed.groupBy(*by, *apart).agg(F.sum("hours").alias("hours"))
    dates = [F.desc(k) for k in ("year", "month", "day") if k in used]
    rest = [F.asc(k) for k in out if k not in ("year", "month", "day")]
    return summed.orderBy(*dates, F.desc("hours"), *rest).select(*out, "hours")


def _dim(t: Tables, name: str) -> DataFrame:
    return listed(t.stage) if name == "stage" else getattr(t, name)


def _dim_filter(dim: str, fields: dict, fixed: dict, relevant, merge_names: bool) -> Column:
    parts = []
    for k, v in fixed.items():
        if fields[k].dim != dim:
            continue
        column = F.col(fields[k].attribute)
        if merge_names and fields[k].attribute == "name":
            parts.append(F.collate(column, NAME_COLLATION) == F.collate(F.lit(v), NAME_COLLATION))
        else:
            parts.append(column == F.lit(v))
    if dim == "project":
        parts.append(relevance(relevant))
    return all_of(parts)


def _merged(field: str, fields: dict, merge_names: bool) -> Column:
    if merge_names and fields[field].attribute == "name":
        return F.collate(F.col(field), NAME_COLLATION).alias(field)
    return F.col(field)


def _needs_second_sum(used: dict, relevant, merge_names: bool) -> bool:
    """The first sum is per dimension key; a second one is due when that is finer than asked."""
    if merge_names and ({"user", "project", "stage"} & set(used)):
        return True
    by_project = "square" in used or relevant is not None
    return by_project and "project" not in used
