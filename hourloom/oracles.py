"""The same queries as SQL over the raw tables, for an independent check."""

from __future__ import annotations

from hourloom.schema import STAGE_NAMES

_STAGE_ROWS = ", ".join(f"({i}, '{name}')" for i, name in enumerate(STAGE_NAMES, start=1))
_STAGES = f"stage AS (SELECT * FROM (VALUES {_STAGE_ROWS}) AS v(id, name))"

_WL_FACT = """fact AS (
  SELECT l_suppkey AS userId, l_partkey AS projectId, l_linenumber AS stageId,
    CAST(l_shipdate AS DATE) AS dateStamp, CAST(l_quantity AS INTEGER) AS hours,
    l_orderkey AS orderKey FROM lineitem)"""

_DIMS = """started AS (SELECT l_partkey AS id, min(CAST(l_shipdate AS DATE)) AS startdate FROM lineitem GROUP BY 1),
project AS (
  SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS name, p_size AS square,
    CAST(p_partkey % 5 + 1 AS INTEGER) AS level, startdate,
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 0 ELSE 1 END AS isDone
  FROM part LEFT JOIN started ON started.id = p_partkey),
deadline AS (
  SELECT p_partkey AS projectId, n AS stageId, max(CAST(l_shipdate AS DATE)) AS finishdate
  FROM part CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS s(n)
  LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = n GROUP BY 1, 2)"""

_WL_USER = """usr AS (
  SELECT s_suppkey AS id, s_name AS name,
    concat('0.', lpad(CAST(s_nationkey AS VARCHAR), 2, '0'), ',0.5,0.25,1') AS color,
    CAST(concat('0.', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS DOUBLE) AS red,
    lower(s_name) AS username, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS admin,
    CASE WHEN s_suppkey % 7 <> 0 THEN 1 ELSE 0 END AS relevant FROM supplier)"""

_CAL_USER = """usr AS (
  SELECT c_custkey AS id, c_name AS name,
    CAST(concat('0.', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS DOUBLE) AS red FROM customer)"""

_EVENT_STAGE = """CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
      WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END"""
_EVENT_HOURS = "CAST(least(12, greatest(1, ceil(value / 20))) AS INTEGER)"
_EVENT_PROJECT = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _cal_fact(folded: bool = False) -> str:
    user = "user_id % 10" if folded else "user_id"
    project = f"{_EVENT_PROJECT} % 5" if folded else _EVENT_PROJECT
    return f"""fact AS (
  SELECT event_id AS id, {user} AS userId, {project} AS projectId, {_EVENT_STAGE} AS stageId,
    CAST(ts AS DATE) AS dateStamp, {_EVENT_HOURS} AS hours FROM events)"""


def _edits(folded: bool = False, deletes: bool = True, next_user: bool = False) -> str:
    user = "user_id % 10" if folded else "user_id"
    project = f"{_EVENT_PROJECT} % 5" if folded else _EVENT_PROJECT
    op = "CASE WHEN event_id % 10 = 0 THEN 'delete' ELSE 'set' END" if deletes else "'set'"
    return f"""edit AS (
  SELECT ts, event_id AS seq, {op} AS op, {user}{' + 1' if next_user else ''} AS userId,
    {project} AS projectId, {_EVENT_STAGE} AS stageId, CAST(ts AS DATE) AS dateStamp,
    {_EVENT_HOURS} AS hour FROM events)"""


_WL = f"WITH {_WL_FACT}, {_DIMS}, {_STAGES}, {_WL_USER}"
_WL_LESS_A_MONTH = f"""WITH every AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS userId, l_partkey AS projectId, l_linenumber AS stageId,
    CAST(l_shipdate AS DATE) AS dateStamp, CAST(l_quantity AS INTEGER) AS hours FROM lineitem),
fact AS (SELECT * FROM every WHERE NOT (year(dateStamp) = 1997 AND month(dateStamp) = 3)), {_DIMS}, {_STAGES}, {_WL_USER}"""
_CAL = f"WITH {_cal_fact()}, {_DIMS}, {_STAGES}, {_CAL_USER}"
_FOLDED = f"WITH {_cal_fact(folded=True)}, {_STAGES}"

_IN_YEAR = "dateStamp >= DATE '1997-01-01' AND dateStamp < DATE '1998-01-01'"
_IN_MONTH = "dateStamp >= DATE '1997-03-01' AND dateStamp < DATE '1997-04-01'"
_Y = "CAST(year(dateStamp) AS INTEGER)"
_M = "CAST(month(dateStamp) AS INTEGER)"
_D = "CAST(day(dateStamp) AS INTEGER)"
_SUM = "CAST(sum(hours) AS BIGINT)"
_RU_MONTH = """CASE m WHEN 1 THEN 'Январь' WHEN 2 THEN 'Февраль' WHEN 3 THEN 'Март' WHEN 4 THEN 'Апрель'
  WHEN 5 THEN 'Май' WHEN 6 THEN 'Июнь' WHEN 7 THEN 'Июль' WHEN 8 THEN 'Август' WHEN 9 THEN 'Сентябрь'
  WHEN 10 THEN 'Октябрь' WHEN 11 THEN 'Ноябрь' WHEN 12 THEN 'Декабрь' ELSE '' END"""


def _hex(red: str = "red") -> str:
    return (
        f"printf('#%02x%02x%02x', CAST(round_even({red} * 255, 0) AS INTEGER), "
        "CAST(round_even(0.5::DOUBLE * 255, 0) AS INTEGER), CAST(round_even(0.25::DOUBLE * 255, 0) AS INTEGER))"
    )


# ---------------------------------------------------------------- board, log, grouping


def _cards(where: str, fact_where: str = "TRUE", join: str = "LEFT JOIN") -> str:
    return f"""{_WL}, agg AS (
  SELECT projectId, count(DISTINCT userId) AS count_users, {_SUM} AS sum_hours, max(dateStamp) AS last_act
  FROM fact WHERE {fact_where} GROUP BY projectId)
SELECT id, name, square, count_users, sum_hours, isDone AS is_done, level, last_act
FROM project {join} agg ON projectId = id WHERE {where}"""


_CURRENT_YEAR = f"isDone <> 1 AND id IN (SELECT projectId FROM fact WHERE {_IN_YEAR})"


def _page(where: str, tail: str) -> str:
    return f"""{_WL}
SELECT {_Y} AS year, {_M} AS month, {_D} AS day, u.name AS user, p.name AS project, s.name AS stage,
  p.square AS square, f.hours AS hours, f.orderKey AS "orderKey", f.stageId AS "stageId",
  f.projectId AS "projectId", f.userId AS "userId"
FROM fact f JOIN usr u ON u.id = f.userId JOIN project p ON p.id = f.projectId JOIN stage s ON s.id = f.stageId
WHERE {where}
ORDER BY dateStamp DESC, orderKey, stageId, projectId, userId, hours {tail}"""


def _grouped(select: dict[str, str], where: str = "TRUE", extra_keys: str = "") -> str:
    columns = ", ".join(f"{e} AS {k}" for k, e in select.items())
    keys = ", ".join([*select.values()] + ([extra_keys] if extra_keys else []))
    return f"""{_WL}
SELECT {columns}, {_SUM} AS hours
FROM fact JOIN usr u ON u.id = userId JOIN project p ON p.id = projectId LEFT JOIN stage s ON s.id = stageId
WHERE {where} GROUP BY {keys}"""


_FACETS = f"""{_WL}
SELECT DISTINCT 'year' AS facet, CAST(year(dateStamp) AS VARCHAR) AS value, CAST(year(dateStamp) AS VARCHAR) AS label FROM fact
UNION ALL SELECT DISTINCT 'month', CAST(month(dateStamp) AS VARCHAR), printf('%02d', CAST(month(dateStamp) AS INTEGER)) FROM fact
UNION ALL SELECT DISTINCT 'day', CAST(day(dateStamp) AS VARCHAR), printf('%02d', CAST(day(dateStamp) AS INTEGER)) FROM fact
UNION ALL SELECT DISTINCT 'user', u.name, u.name FROM fact JOIN usr u ON u.id = userId
UNION ALL SELECT DISTINCT 'project', p.name, p.name FROM fact JOIN project p ON p.id = projectId
UNION ALL SELECT DISTINCT 'square', CAST(square AS VARCHAR), CAST(square AS VARCHAR) FROM fact JOIN project p ON p.id = projectId
UNION ALL SELECT DISTINCT 'stage', s.name, s.name FROM fact JOIN stage s ON s.id = stageId"""

_CHART_FACETS = f"""{_WL}, span AS (SELECT min(year(dateStamp)) AS y FROM fact)
SELECT 'year' AS facet, CAST(g AS VARCHAR) AS value, CAST(g AS VARCHAR) AS label
  FROM generate_series(1900, 2002) AS t(g), span WHERE g >= y
UNION ALL SELECT 'month', CAST(m AS VARCHAR), {_RU_MONTH} FROM (SELECT DISTINCT month(dateStamp) AS m FROM fact)
UNION ALL SELECT 'user', CAST(id AS VARCHAR), name FROM usr WHERE id IN (SELECT userId FROM fact)
UNION ALL SELECT 'project', CAST(id AS VARCHAR), name FROM project"""


# ---------------------------------------------------------------- lines, matrix, spans


def _project_lines(x: str, where: str) -> str:
    return f"""SELECT projectId AS project_id, userId AS user_id, u.name AS user, u.color AS color, {x} AS x, {_SUM} AS hours
FROM fact JOIN usr u ON u.id = userId WHERE {where} GROUP BY 1, 2, 3, 4, 5"""


def _gaps(x: str, where: str) -> str:
    return f"""{_WL}, line AS (
  SELECT projectId AS project_id, userId AS user_id, {x} AS x, {_SUM} AS hours
  FROM fact JOIN usr u ON u.id = userId JOIN project p ON p.id = projectId WHERE {where} GROUP BY 1, 2, 3),
nxt AS (SELECT *, lead(x) OVER (PARTITION BY project_id, user_id ORDER BY x) - x > 1 AS gap FROM line),
pts AS (
  SELECT project_id, user_id, x AS pt, 0 AS part, x, hours FROM nxt
  UNION ALL SELECT project_id, user_id, x, 1, NULL, NULL FROM nxt WHERE gap)
SELECT project_id, user_id,
  CAST(row_number() OVER (PARTITION BY project_id, user_id ORDER BY pt, part) AS INTEGER) AS seq,
  CAST(x AS INTEGER) AS x, CAST(hours AS BIGINT) AS hours FROM pts"""


def _matrix(where: str) -> str:
    return f"""{_WL}, cell AS (
  SELECT projectId, stageId, userId, hours FROM fact WHERE stageId <= 6 AND {where}),
people AS (SELECT DISTINCT projectId, userId FROM cell),
filled AS (
  SELECT p.projectId, s.id AS stageId, p.userId, coalesce(sum(c.hours), 0) AS hours
  FROM people p CROSS JOIN stage s
  LEFT JOIN cell c ON c.projectId = p.projectId AND c.userId = p.userId AND c.stageId = s.id GROUP BY 1, 2, 3),
g AS (
  SELECT projectId, stageId, userId, grouping(stageId) AS gs, grouping(userId) AS gu, sum(hours) AS hours
  FROM filled GROUP BY GROUPING SETS ((projectId, stageId, userId), (projectId, stageId), (projectId, userId), (projectId)))
SELECT projectId AS project_id, CASE WHEN gs = 1 THEN 7 ELSE CAST(stageId AS INTEGER) END AS stage_order,
  CASE WHEN gs = 1 THEN 'Σ' ELSE s.name END AS stage, userId AS user_id,
  CASE WHEN gu = 1 THEN 'Σ' ELSE u.name END AS user, CAST(hours AS BIGINT) AS hours,
  CASE WHEN gs = 1 OR gu = 1 THEN 1 ELSE 0 END AS is_total
FROM g LEFT JOIN stage s ON s.id = stageId LEFT JOIN usr u ON u.id = userId"""


_USER_PROJECTS = f"""{_WL}
SELECT userId AS user_id, projectId AS project_id, p.name AS project, substr(p.name, 1, 30) AS header, {_SUM} AS hours
FROM fact JOIN project p ON p.id = projectId WHERE {_IN_YEAR} GROUP BY 1, 2, 3, 4"""


def _gantt(where: str) -> str:
    return f"""{_WL}, spans AS (
  SELECT name, startdate, CAST(month(min(dateStamp)) AS INTEGER) AS start_m, CAST(month(max(dateStamp)) AS INTEGER) AS end_m
  FROM project JOIN fact ON projectId = project.id WHERE {_IN_YEAR} AND {where} GROUP BY name, startdate)
SELECT name, start_m, end_m, CASE WHEN end_m = start_m THEN 0.2::DOUBLE ELSE CAST(end_m - start_m AS DOUBLE) END AS span,
  CAST(row_number() OVER (ORDER BY name, startdate) - 1 AS DOUBLE) / greatest(count(*) OVER () - 1, 1) AS pos FROM spans"""


# ---------------------------------------------------------------- calendar


def _detail(where: str) -> str:
    return f"""{_CAL}
SELECT projectId AS project_id, {_Y} AS year, {_M} AS month, {_D} AS day, stageId AS stage_id, s.name AS stage,
  userId AS user_id, {_hex()} AS color, hours
FROM fact JOIN usr u ON u.id = userId JOIN stage s ON s.id = stageId WHERE {where}"""


_LEGEND = f"""{_CAL}
SELECT DISTINCT projectId AS project_id, {_Y} AS year, {_M} AS month, userId AS user_id, u.name AS name, {_hex()} AS color
FROM fact JOIN usr u ON u.id = userId"""


def _day_columns(today: str) -> str:
    return f"""date, CAST(year(date) AS INTEGER) AS year, m AS month, CAST(day(date) AS INTEGER) AS day,
  {_RU_MONTH} AS month_name, CAST(day(last_day(date)) AS INTEGER) AS num_days,
  CASE WHEN isodow(date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN date = DATE '{today}' THEN 1 ELSE 0 END AS is_today"""


_DAYS = f"""{_CAL}, pm AS (SELECT DISTINCT projectId AS project_id, CAST(date_trunc('month', dateStamp) AS DATE) AS a FROM fact),
days AS (SELECT project_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(last_day(a) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM pm)
SELECT project_id, {_day_columns('2024-01-15')} FROM (SELECT *, CAST(month(date) AS INTEGER) AS m FROM days)"""

_DATES = f"""{_WL}, span AS (SELECT CAST(date_trunc('month', min(dateStamp)) AS TIMESTAMP) AS a, CAST(last_day(max(dateStamp)) AS TIMESTAMP) AS b FROM fact),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT {_day_columns('1997-03-09')} FROM (SELECT *, CAST(month(date) AS INTEGER) AS m FROM days)"""

_FLAGS = """flags AS (
  SELECT e.projectId, e.stageId, e.dateStamp, e.userId, e.hours, e.entries,
    CASE WHEN l.top >= e.hours THEN 1 ELSE 0 END AS left_f, CASE WHEN r.top >= e.hours THEN 1 ELSE 0 END AS right_f
  FROM (SELECT projectId, stageId, dateStamp, userId, hours, count(*) AS entries FROM fact GROUP BY ALL) e
  LEFT JOIN daily l ON l.projectId = e.projectId AND l.stageId = e.stageId AND l.userId = e.userId AND l.dateStamp = e.dateStamp - 1
  LEFT JOIN daily r ON r.projectId = e.projectId AND r.stageId = e.stageId AND r.userId = e.userId AND r.dateStamp = e.dateStamp + 1)"""
_DAILY = "daily AS (SELECT projectId, stageId, dateStamp, userId, max(hours) AS top FROM fact GROUP BY ALL)"

_CONTIGUITY = f"""{_FOLDED}, {_DAILY}, {_FLAGS}
SELECT projectId AS project_id, stageId AS stage_id, dateStamp AS date, userId AS user_id, hours, entries, left_f, right_f FROM flags"""


def _grid(head: str) -> str:
    return f"""{head}, {_DAILY}, {_FLAGS},
pm AS (SELECT DISTINCT projectId, CAST(date_trunc('month', dateStamp) AS DATE) AS a FROM fact),
frame AS (
  SELECT projectId, date, id AS stageId, name AS stage, hour FROM (
    SELECT projectId, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(last_day(a) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM pm)
  CROSS JOIN stage CROSS JOIN generate_series(1, 12) AS h(hour)),
cover AS (
  SELECT f.projectId, f.stageId, f.dateStamp, h.hour, f.userId, f.hours,
    row_number() OVER (PARTITION BY f.projectId, f.stageId, f.dateStamp, h.hour ORDER BY f.userId, f.hours DESC) AS rn
  FROM fact f JOIN generate_series(1, 12) AS h(hour) ON h.hour <= f.hours),
cell AS (
  SELECT projectId, stageId, dateStamp, hour, CAST(least(count(*), 2) AS INTEGER) AS n,
    max(CASE WHEN rn = 1 THEN userId END) AS u1, max(CASE WHEN rn = 2 THEN userId END) AS u2,
    max(CASE WHEN rn = 1 THEN hours END) AS h1, max(CASE WHEN rn = 2 THEN hours END) AS h2
  FROM cover GROUP BY ALL)
SELECT g.projectId AS project_id, CAST(year(g.date) AS INTEGER) AS year, CAST(month(g.date) AS INTEGER) AS month,
  g.stageId AS stage_id, g.stage AS stage, CAST(day(g.date) AS INTEGER) AS day, CAST(g.hour AS INTEGER) AS hour, coalesce(n, 0) AS n, u1, u2,
  CASE WHEN h1 = g.hour AND coalesce(h2, g.hour) = g.hour THEN 1 ELSE 0 END AS is_top,
  CASE WHEN n = 1 AND h1 = g.hour THEN left_f ELSE 0 END AS left_f,
  CASE WHEN n = 1 AND h1 = g.hour THEN right_f ELSE 0 END AS right_f
FROM frame g LEFT JOIN cell c ON c.projectId = g.projectId AND c.stageId = g.stageId AND c.dateStamp = g.date AND c.hour = g.hour
LEFT JOIN flags k ON k.projectId = c.projectId AND k.stageId = c.stageId AND k.dateStamp = c.dateStamp AND k.userId = c.u1 AND k.hours = c.h1"""


# ---------------------------------------------------------------- directories

_USERS = f"""{_WL}
SELECT id, name, username AS login, color, concat('rgba(', CAST(floor(red * 255) AS INTEGER), ', 127, 63, 1.0)') AS css,
  CASE WHEN admin = 1 THEN 'Да' ELSE 'Нет' END AS admin, CASE WHEN relevant = 1 THEN 'Актуальный' ELSE 'Не актуальный' END AS status
FROM usr"""

_LOOKUP = f"""{_WL}
SELECT 'user' AS kind, CAST(id AS VARCHAR) AS key, username AS value FROM usr WHERE id IN (SELECT userId FROM fact)
UNION ALL SELECT 'user name', CAST(id AS VARCHAR), name FROM usr WHERE id IN (SELECT userId FROM fact)
UNION ALL SELECT 'login', CAST(id AS VARCHAR), username FROM usr WHERE id IN (SELECT userId FROM fact)
UNION ALL SELECT 'project', CAST(id AS VARCHAR), CAST(square AS VARCHAR) FROM project WHERE id IN (SELECT projectId FROM fact)
UNION ALL SELECT 'project name', CAST(id AS VARCHAR), name FROM project WHERE id IN (SELECT projectId FROM fact)
UNION ALL SELECT 'project title', CAST(id AS VARCHAR), upper(name) FROM project WHERE id IN (SELECT projectId FROM fact)
UNION ALL SELECT 'user of login', upper(username), CAST(id AS VARCHAR) FROM usr WHERE relevant = 1
UNION ALL SELECT 'login of name', lower(name), username FROM usr WHERE relevant = 1"""

_PALETTE = "['#66C2A5', '#FC8D62', '#8DA0CB', '#E78AC3', '#A6D854', '#FFD92F', '#E5C494', '#B3B3B3']"


# ---------------------------------------------------------------- edits

_SLOT = "projectId, stageId, dateStamp"
_NAMED = "projectId AS project_id, stageId AS stage_id, dateStamp AS date, userId AS user_id, hours"


def _first_two() -> str:
    return f"""WITH {_edits(deletes=False)},
person AS (SELECT {_SLOT}, userId, min((ts, seq)) AS first, arg_max(hour, (ts, seq)) AS hours FROM edit GROUP BY ALL),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY {_SLOT} ORDER BY first) AS place FROM person)"""


_OVER = f"""WITH {_cal_fact()}, {_edits(deletes=False, next_user=True)},
held AS (SELECT {_SLOT}, userId, min(id) AS own FROM fact GROUP BY ALL),
holders AS (SELECT {_SLOT}, count(*) AS n FROM held GROUP BY ALL),
asked AS (SELECT {_SLOT}, userId, min((ts, seq)) AS first, arg_max(hour, (ts, seq)) AS hours FROM edit GROUP BY ALL),
known AS (
  SELECT a.*, h.own, coalesce(o.n, 0) AS n FROM asked a
  LEFT JOIN held h ON h.projectId = a.projectId AND h.stageId = a.stageId AND h.dateStamp = a.dateStamp AND h.userId = a.userId
  LEFT JOIN holders o ON o.projectId = a.projectId AND o.stageId = a.stageId AND o.dateStamp = a.dateStamp),
newcomer AS (SELECT *, row_number() OVER (PARTITION BY {_SLOT} ORDER BY first) AS place FROM known WHERE own IS NULL)
SELECT f.projectId AS project_id, f.stageId AS stage_id, f.dateStamp AS date, f.userId AS user_id, coalesce(k.hours, f.hours) AS hours
FROM fact f LEFT JOIN known k ON k.own = f.id AND k.n <= 2
UNION ALL SELECT {_NAMED} FROM newcomer WHERE n + place <= 2"""


def _mixed(folded: bool = False) -> str:
    """Slots advance together, one edit per step; u1/u2 are the seats."""
    return f"""WITH RECURSIVE {_edits(folded)},
e AS (SELECT *, row_number() OVER (PARTITION BY {_SLOT} ORDER BY ts, seq) AS n FROM edit),
walk AS (
  SELECT DISTINCT {_SLOT}, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS u1, CAST(NULL AS INTEGER) AS h1,
    CAST(NULL AS BIGINT) AS u2, CAST(NULL AS INTEGER) AS h2, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS status FROM edit
  UNION ALL
  SELECT e.projectId, e.stageId, e.dateStamp, e.n,
    CASE WHEN op = 'delete' AND u1 = userId AND hour <= h1 THEN NULL WHEN op = 'set' AND u1 IS NULL AND u2 IS DISTINCT FROM userId THEN userId ELSE u1 END,
    CASE WHEN op = 'set' AND (u1 = userId OR (u1 IS NULL AND u2 IS DISTINCT FROM userId)) THEN hour ELSE h1 END,
    CASE WHEN op = 'delete' AND u2 = userId AND hour <= h2 THEN NULL WHEN op = 'set' AND u2 IS NULL AND u1 IS NOT NULL AND u1 <> userId THEN userId ELSE u2 END,
    CASE WHEN op = 'set' AND (u2 = userId OR (u2 IS NULL AND u1 IS NOT NULL AND u1 <> userId)) THEN hour ELSE h2 END,
    e.seq,
    CASE WHEN op = 'set' THEN CASE WHEN u1 IS NULL OR u2 IS NULL OR u1 = userId OR u2 = userId THEN 'saved' ELSE 'day full' END
      WHEN (u1 = userId AND hour <= h1) OR (u2 = userId AND hour <= h2) THEN 'deleted' ELSE 'nothing to delete' END
  FROM walk w JOIN e ON e.projectId = w.projectId AND e.stageId = w.stageId AND e.dateStamp = w.dateStamp AND e.n = w.n + 1)"""


def _seats(folded: bool = False) -> str:
    return f"""{_mixed(folded)},
done AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY {_SLOT}) AS last FROM walk) WHERE n = last)
SELECT projectId AS project_id, stageId AS stage_id, dateStamp AS date, u1 AS user_id, h1 AS hours FROM done WHERE u1 IS NOT NULL
UNION ALL SELECT projectId, stageId, dateStamp, u2, h2 FROM done WHERE u2 IS NOT NULL"""


def _walk_over_log() -> str:
    """Mixed edits over a filled log: each slot's entries as a list in id order, one edit per
    step; doubled and over-full slots included."""
    at = "list_position(list_transform(held, lambda x: x.u), e.userId)"
    others = "len(list_distinct(list_filter(list_transform(held, lambda x: x.u), lambda x: x <> e.userId)))"
    gone = "list_concat(list_slice(held, 1, own - 1), list_slice(held, own + 1, len(held)))"
    changed = (
        "list_concat(list_concat(list_slice(held, 1, own - 1), [{'u': userId, 'h': hour}]), "
        "list_slice(held, own + 1, len(held)))"
    )
    return f"""WITH RECURSIVE {_cal_fact()}, {_edits(next_user=True)},
e AS (SELECT *, row_number() OVER (PARTITION BY {_SLOT} ORDER BY ts, seq) AS n FROM edit),
slots AS (SELECT DISTINCT {_SLOT} FROM edit),
start AS (
  SELECT {_SLOT}, coalesce(list({{'u': userId, 'h': CAST(hours AS INTEGER)}} ORDER BY id) FILTER (id IS NOT NULL), []) AS held
  FROM slots LEFT JOIN fact USING ({_SLOT}) GROUP BY {_SLOT}),
walk AS (
  SELECT {_SLOT}, CAST(0 AS BIGINT) AS n, held, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS status FROM start
  UNION ALL
  SELECT projectId, stageId, dateStamp, n,
    CASE WHEN op = 'delete' THEN CASE WHEN own > 0 AND hour <= held[own].h THEN {gone} ELSE held END
      WHEN others >= 2 THEN held WHEN own > 0 THEN {changed}
      ELSE list_append(held, {{'u': userId, 'h': hour}}) END,
    seq,
    CASE WHEN op = 'delete' THEN CASE WHEN own > 0 AND hour <= held[own].h THEN 'deleted' ELSE 'nothing to delete' END
      WHEN others >= 2 THEN 'day full' ELSE 'saved' END
  FROM (
    SELECT e.*, w.held, coalesce({at}, 0) AS own, {others} AS others
    FROM walk w JOIN e ON e.projectId = w.projectId AND e.stageId = w.stageId AND e.dateStamp = w.dateStamp AND e.n = w.n + 1))"""


def _log_after_walk() -> str:
    return f"""{_walk_over_log()},
done AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY {_SLOT}) AS last FROM walk) WHERE n = last),
left_over AS (SELECT {_SLOT}, unnest(held) AS entry FROM done)
SELECT projectId AS project_id, stageId AS stage_id, dateStamp AS date, entry.u AS user_id, entry.h AS hours FROM left_over
UNION ALL SELECT projectId, stageId, dateStamp, userId, hours FROM fact ANTI JOIN slots USING ({_SLOT})"""


# ---------------------------------------------------------------- maintenance

_NEW_USERS = """batch AS (
  SELECT c_custkey AS seq, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_name) END AS username,
    c_custkey % 7 = 0 AS bad_admin,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey // 10 AS VARCHAR) || CAST(c_nationkey % 10 AS VARCHAR) END AS pair
  FROM customer)"""

_INSERTED_USERS = f"""{_WL}, {_NEW_USERS}
SELECT id, name, color, username, admin, relevant FROM usr
UNION ALL
SELECT (SELECT max(id) FROM usr) + 1 + seq - (SELECT min(seq) FROM batch WHERE username IS NOT NULL AND NOT bad_admin), name,
  CASE WHEN pair IS NULL THEN '0.5,0.5,0.5,1' ELSE concat('1.0, 0.0, ', CAST(round((16 * CAST(pair[1] AS INTEGER) + CAST(pair[2] AS INTEGER)) / 255.0::DOUBLE, 3) AS VARCHAR), ', 1.0') END,
  username, 0, 1 FROM batch WHERE username IS NOT NULL AND NOT bad_admin"""

_NEW_PROJECTS = """pbatch AS (
  SELECT c_custkey * 4 AS seq, c_name AS name, c_nationkey AS square, DATE '2001-05-05' AS stage2 FROM customer
  UNION ALL SELECT c_custkey * 4 + 1, upper(c_name), 10, NULL FROM customer
  UNION ALL SELECT s_suppkey * 4 + 2, s_name, NULL, NULL FROM supplier
  UNION ALL SELECT p_partkey * 4 + 3, concat(p_name, ' ', p_partkey), 5, NULL FROM part),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY seq) > 1 AS repeated,
    lower(name) IN (SELECT lower(name) FROM project) AS taken FROM pbatch)"""

_INSERTED_PROJECTS = f"""{_WL}, {_NEW_PROJECTS},
ok AS (SELECT * FROM judged WHERE square IS NOT NULL AND NOT repeated AND NOT taken),
whole AS (
  SELECT id, name, square, level, startdate, isDone, stageId, finishdate FROM project JOIN deadline ON projectId = id
  UNION ALL
  SELECT (SELECT max(id) FROM project) + 1 + seq - (SELECT min(seq) FROM ok), name, square, 1, DATE '2002-01-01', 0, n,
    CASE WHEN n = 2 THEN stage2 END FROM ok CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS s(n))
SELECT id, name, square, level, startdate, isDone AS is_done, stageId AS stage_id, finishdate AS finish_date FROM whole"""

_REJECTS = f"""{_WL}, {_NEW_USERS}, {_NEW_PROJECTS}
SELECT 'user' AS batch, seq, concat_ws(', ', CASE WHEN username IS NULL THEN 'no login' END, CASE WHEN bad_admin THEN 'bad admin' END) AS reason
FROM batch WHERE username IS NULL OR bad_admin
UNION ALL
SELECT 'project', seq, concat_ws(', ', CASE WHEN square IS NULL THEN 'no square' END, CASE WHEN taken THEN 'name taken' END, CASE WHEN repeated THEN 'name repeated' END)
FROM judged WHERE square IS NULL OR taken OR repeated"""


def _audit(fact: str, key: str) -> str:
    zero = "CAST(0 AS BIGINT)"
    repeated = "SELECT '{0}' AS finding, count(*) AS n FROM (SELECT 1 FROM {1} GROUP BY {2} HAVING count(*) > 1)"
    parts = [
        repeated.format("main: key repeated", "fact", key),
        repeated.format("project: id repeated", "project", "id"),
        repeated.format("project: name repeated", "project", "lower(name)"),
        repeated.format("projectstage: key repeated", "deadline", "projectId, stageId"),
        repeated.format("stage: id repeated", "stage", "id"),
        repeated.format("user: id repeated", "usr", "id"),
    ]
    missing = {
        "main": ("fact", ["userId", "projectId", "stageId", "dateStamp", "hours"] + (["id"] if key == "id" else [])),
        "project": ("project", ["id", "name", "isDone"]),
        "projectstage": ("deadline", ["projectId", "stageId"]),
        "stage": ("stage", ["id", "name"]),
        "user": ("usr", ["id", "name"]),
    }
    for label, (table, columns) in missing.items():
        for c in columns:
            parts.append(f"SELECT '{label}: {c} missing', count(*) FROM {table} WHERE {c} IS NULL")
    for c in ("username", "admin", "relevant"):
        parts.append(f"SELECT 'user: {c} missing', {zero}")
    parts += [
        "SELECT 'main: hours out of range', count(*) FROM fact WHERE hours NOT BETWEEN 1 AND 12",
        "SELECT 'project: isDone not a flag', count(*) FROM project WHERE isDone NOT IN (0, 1)",
        "SELECT 'project: level out of range', count(*) FROM project WHERE level NOT BETWEEN 1 AND 5",
        "SELECT 'projectstage: finishdate missing', count(*) FROM deadline WHERE finishdate IS NULL",
        f"SELECT 'user: admin not a flag', {zero}",
        f"SELECT 'user: relevant not a flag', {zero}",
        f"SELECT 'user: color unreadable', {zero}",
        "SELECT 'main: user unknown', count(*) FROM fact WHERE userId NOT IN (SELECT id FROM usr)",
        "SELECT 'main: project unknown', count(*) FROM fact WHERE projectId NOT IN (SELECT id FROM project)",
        "SELECT 'main: stage unknown', count(*) FROM fact WHERE stageId NOT IN (SELECT id FROM stage)",
        "SELECT 'projectstage: project unknown', count(*) FROM deadline WHERE projectId NOT IN (SELECT id FROM project)",
        "SELECT 'projectstage: stage unknown', count(*) FROM deadline WHERE stageId NOT IN (SELECT id FROM stage)",
        f"SELECT 'main: entry doubled', count(*) FROM (SELECT 1 FROM fact GROUP BY {_SLOT}, userId HAVING count(*) > 1)",
        f"SELECT 'main: slot over-full', count(*) FROM (SELECT 1 FROM fact GROUP BY {_SLOT} HAVING count(DISTINCT userId) > 2)",
        "SELECT 'main: day too long', count(*) FROM (SELECT 1 FROM fact GROUP BY userId, dateStamp HAVING sum(hours) > 12)",
    ]
    return fact + "\n" + "\nUNION ALL ".join(parts)


_SHOWN = "fact JOIN project p ON p.id = projectId JOIN usr u ON u.id = userId JOIN stage s ON s.id = stageId"


def oracle_sql() -> dict[str, str]:
    y, m, d = f"{_Y}", f"{_M}", f"{_D}"
    return {
        "r01_cards_current_year": _cards(_CURRENT_YEAR),
        "r01_cards_archived": _cards("isDone <> 0"),
        "r01_cards_all": _cards("TRUE"),
        "r01_cards_scoped": _cards("TRUE", _IN_YEAR, "JOIN"),
        "r01_cards_of_years": _cards("TRUE", "year(dateStamp) BETWEEN 1997 AND 1998", "JOIN"),
        "r02_status_counts": f"{_WL} SELECT isDone AS is_done, count(*) AS n FROM project GROUP BY 1",
        "r02_current_count": f"{_WL} SELECT count(*) AS n FROM project WHERE isDone <> 1",
        "r03_user_status_counts": f"""{_WL}
SELECT userId AS user_id, isDone AS is_done, count(DISTINCT projectId) AS n FROM fact JOIN project p ON p.id = projectId GROUP BY 1, 2""",
        "r03_one_user": f"{_WL} SELECT count(DISTINCT projectId) AS n FROM fact JOIN project p ON p.id = projectId WHERE userId = 3 AND isDone <> 1",
        "r04_years": f"{_WL} SELECT DISTINCT {_Y} AS year FROM fact",
        "r05_facets": _FACETS,
        "r06_chart_facets": _CHART_FACETS,
        "r07_page": _page("TRUE", "LIMIT 40 OFFSET 80"),
        "r07_page_done": _page("isDone = 1", "LIMIT 40 OFFSET 80"),
        "r07_page_deep": _page("TRUE", "LIMIT 40 OFFSET 40000"),
        "r07_page_after": _page(
            "dateStamp < DATE '1999-06-15' OR (dateStamp = DATE '1999-06-15' AND orderKey >= 100)", "LIMIT 40"
        ),
        "r08_count": f"{_WL} SELECT count(*) AS n FROM {_SHOWN}",
        "r08_count_current": f"{_WL} SELECT count(*) AS n FROM {_SHOWN} WHERE isDone = 0",
        "r09_by_year": _grouped({"year": y}),
        "r09_by_year_month": _grouped({"year": y, "month": m}),
        "r09_by_date": _grouped({"year": y, "month": m, "day": d}),
        "r09_by_user": _grouped({"user": "u.name"}, extra_keys="u.id"),
        "r09_by_project_size": _grouped({"square": "p.square"}),
        "r09_by_stage_user": _grouped(
            {"user": "u.name", "stage": "s.name"}, "s.name = '3D ГРАФИКА'", "u.id"
        ),
        "r09_by_user_fixed": _grouped(
            {"year": y, "user": "u.name", "project": "p.name"}, "u.name = 'Supplier#000000007'", "u.id, p.id"
        ),
        "r09_by_relevant_project": _grouped({"project": "p.name"}, "isDone = 0", "p.id"),
        "r09_by_relevant_year": _grouped({"year": y, "month": m}, f"isDone = 1 AND {_IN_YEAR}"),
        "r09_by_all_fields": _grouped(
            {"year": y, "month": m, "day": d, "user": "u.name", "project": "p.name", "square": "p.square", "stage": "s.name"},
            "s.id IS NOT NULL",
            "u.id, p.id",
        ),
        "r09_merged_names": _grouped({"user": "u.name"}),
        "r10_lines_month": f"{_WL} {_project_lines(_M, _IN_YEAR)}",
        "r10_lines_day": f"{_WL} {_project_lines(_D, _IN_MONTH)}",
        "r11_user_lines": f"""{_WL}
SELECT userId AS user_id, projectId AS project_id, p.name AS project, {_M} AS x, {_SUM} AS hours
FROM fact JOIN project p ON p.id = projectId WHERE {_IN_YEAR} GROUP BY 1, 2, 3, 4""",
        "r12_gaps": _gaps(_M, _IN_YEAR),
        "r12_user_gaps": _gaps(_D, _IN_MONTH),
        "r13_matrix_long": _matrix(_IN_YEAR),
        "r13_matrix_month": _matrix(_IN_MONTH),
        "r13_matrix_maps": f"""SELECT project_id, stage, string_agg("user" || '=' || hours, ';' ORDER BY "user") AS cells
FROM (SELECT project_id, stage, "user", sum(hours) AS hours FROM ({_matrix(_IN_YEAR)}) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        "r14_user_maps": f"""SELECT user_id, string_agg(project || '=' || hours, ';' ORDER BY project) AS cells
FROM (SELECT user_id, project, sum(hours) AS hours FROM ({_USER_PROJECTS}) GROUP BY 1, 2) GROUP BY 1""",
        "p12_headers": f"{_WL} SELECT id, name, split_part(name, ' ', 1) AS header FROM usr",
        "p24_log_headers": f"""SELECT year AS "ГОД", month AS "ММ", day AS "ДД", "user" AS "СОТРУДНИК", project AS "ПРОЕКТ",
  stage AS "ЭТАП", square AS "м²", hours AS "ЧАСЫ", "orderKey", "stageId", "projectId", "userId"
FROM ({_page("TRUE", "LIMIT 40")})""",
        "p24_user_headers": f"""SELECT id, name AS "ИМЯ", login AS "ЛОГИН", color AS "ЦВЕТ", admin AS "АДМИН", status AS "СТАТУС"
FROM ({_USERS})""",
        "r14_user_projects": _USER_PROJECTS,
        "r15_gantt": _gantt("TRUE"),
        "r15_gantt_current": _gantt("isDone = 0"),
        "r16_detail": _detail("TRUE"),
        "r16_detail_stage": _detail("s.name = 'ЗАКАЗНЫЕ ПОЗИЦИИ' AND dateStamp BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"),
        "r17_legend": _LEGEND,
        "r18_contiguity": _CONTIGUITY,
        "r19_grid": _grid(_FOLDED),
        "r19_grid_plain": _grid(f"WITH {_cal_fact()}, {_STAGES}"),
        "r20_days": _DAYS,
        "r20_dates": _DATES,
        "r21_deadlines": f"""{_WL}
SELECT p.id AS project_id, s.id AS stage_id, s.name AS stage, finishdate AS finish_date
FROM project p CROSS JOIN stage s LEFT JOIN deadline d ON d.projectId = p.id AND d.stageId = s.id""",
        "r22_latest_project": f"{_CAL} SELECT userId AS user_id, arg_max(projectId, id) AS project_id FROM fact GROUP BY 1",
        "r23_users": _USERS,
        "r24_projects": f"""{_WL}
SELECT id, name, square, startdate, CASE WHEN isDone = 0 THEN 'Актуальный' ELSE 'Не актуальный' END AS status FROM project""",
        "r25_lookup": _LOOKUP,
        "r26_first_names": f"""{_WL}
SELECT DISTINCT projectId AS project_id, CASE WHEN instr(u.name, ' ') > 0 THEN left(u.name, instr(u.name, ' ') - 1) ELSE '' END AS first_name, {_hex()} AS color
FROM fact JOIN usr u ON u.id = userId""",
        "r27_user_colours": f"""{_WL}
SELECT DISTINCT projectId AS project_id, userId AS user_id, u.name AS user, {_hex()} AS color
FROM fact JOIN usr u ON u.id = userId WHERE {_IN_YEAR}""",
        "r27_project_colours": f"""{_WL}, seen AS (
  SELECT DISTINCT userId AS user_id, projectId AS project_id, p.name AS project FROM fact JOIN project p ON p.id = projectId WHERE {_IN_YEAR})
SELECT user_id, project_id, project, {_PALETTE}[1 + (dense_rank() OVER (PARTITION BY user_id ORDER BY project) - 1) % 8] AS color FROM seen""",
        "m01_upsert": f"{_first_two()} SELECT {_NAMED} FROM ranked WHERE place <= 2",
        "m01_statuses": f"""{_first_two()}
SELECT e.seq AS seq, CASE WHEN place <= 2 THEN 'saved' ELSE 'day full' END AS status FROM edit e
JOIN ranked r ON r.projectId = e.projectId AND r.stageId = e.stageId AND r.dateStamp = e.dateStamp AND r.userId = e.userId""",
        "m01_over_snapshot": _OVER,
        "m02_fold": _seats(),
        "m02_statuses": f"{_mixed()} SELECT seq, status FROM walk WHERE n > 0",
        "m02_fold_folded": _seats(folded=True),
        "m02_over_snapshot": _log_after_walk(),
        "m02_over_statuses": f"{_walk_over_log()} SELECT seq, status FROM walk WHERE n > 0",
        "s01_stream": _seats(),
        "s01_seeded": _log_after_walk(),
        "s01_published": _log_after_walk(),
        "s01_statuses": f"{_walk_over_log()} SELECT seq, status FROM walk WHERE n > 0",
        "p19_command_rejects": """
WITH c AS (
  SELECT event_id AS seq, CAST(event_id % 13 + 1 AS INTEGER) AS month, event_id % 11 = 0 AS unknown, event_id % 14 AS hour,
    CAST(year(ts) AS INTEGER) AS y, CAST(day(ts) AS INTEGER) AS d FROM events),
r AS (
  SELECT seq, concat_ws(', ',
    CASE WHEN month > 12 OR TRY_CAST(concat(y, '-', lpad(CAST(month AS VARCHAR), 2, '0'), '-', lpad(CAST(d AS VARCHAR), 2, '0')) AS DATE) IS NULL THEN 'no such day' END,
    CASE WHEN unknown THEN 'unknown op' END, CASE WHEN hour NOT BETWEEN 1 AND 12 THEN 'bad hour' END) AS reason FROM c)
SELECT * FROM r WHERE reason <> ''""",
        "m03_cascade": f"""{_WL}
SELECT u.id AS user_id, count(userId) AS n FROM usr u LEFT JOIN fact ON userId = u.id WHERE relevant <> 0 GROUP BY 1""",
        "m03_insert": _INSERTED_USERS,
        "m03_update": f"""{_WL}
SELECT id, CASE WHEN relevant = 1 AND id % 3 = 0 THEN upper(name) ELSE name END AS name,
  CASE WHEN relevant = 1 THEN '0.251, 0.502, 1.0, 1.0' ELSE color END AS color, username, admin, relevant FROM usr""",
        "m03_update_rejects": f"""{_WL}
SELECT id AS seq, concat_ws(', ', CASE WHEN id % 4 = 0 THEN 'bad admin' END, CASE WHEN id % 3 = 0 THEN 'bad color' END) AS reason
FROM usr WHERE id % 4 = 0 OR id % 3 = 0""",
        "m04_update": f"""{_WL}
SELECT p.id, CASE WHEN p.id % 10 = 1 AND q.id IS NOT NULL AND row_number() OVER (PARTITION BY p.id % 10 = 1 AND q.id IS NOT NULL, p.id // 20 ORDER BY p.id) = 1
    THEN concat('Renamed ', p.id // 20) ELSE p.name END AS name,
  CASE WHEN p.id % 10 = 1 THEN 1 ELSE p.isDone END AS is_done
FROM project p LEFT JOIN project q ON q.id = p.id + 1""",
        "m05_patch_repeated": f"""{_WL}
SELECT projectId AS project_id, stageId AS stage_id, CASE WHEN stageId = 2 THEN startdate + 14 ELSE finishdate END AS finish_date
FROM deadline JOIN project p ON p.id = projectId""",
        "m04_cascade": f"""{_WL}
SELECT id AS project_id, 1::BIGINT AS n, 'project' AS "table" FROM project WHERE isDone <> 1
UNION ALL SELECT projectId, count(*), 'projectstage' FROM deadline WHERE projectId IN (SELECT id FROM project WHERE isDone <> 1) GROUP BY 1
UNION ALL SELECT projectId, count(*), 'main' FROM fact WHERE projectId IN (SELECT id FROM project WHERE isDone <> 1) GROUP BY 1""",
        "m04_insert": _INSERTED_PROJECTS,
        "m05_patch": f"""{_WL}
SELECT projectId AS project_id, stageId AS stage_id, CASE WHEN isDone = 0 AND stageId IN (2, 5) THEN startdate + 7 ELSE finishdate END AS finish_date
FROM deadline JOIN project p ON p.id = projectId""",
        "m06_rejects": _REJECTS,
        "d01_audit": _audit(_WL, "dateStamp, orderKey, stageId, projectId, userId, hours"),
        "d01_audit_calendar": _audit(_CAL, "id"),
        "d01_after_edits": _audit(_WL_LESS_A_MONTH, "id"),
        "i01_ingest_all": f"""{_WL}
SELECT 'main' AS "table", count(*) AS n, {_SUM} AS total FROM fact
UNION ALL SELECT 'project', count(*), CAST(sum(square) AS BIGINT) FROM project
UNION ALL SELECT 'projectstage', count(*), count(finishdate) FROM deadline
UNION ALL SELECT 'stage', count(*), CAST(sum(id) AS BIGINT) FROM stage
UNION ALL SELECT 'user', count(*), CAST(sum(relevant) AS BIGINT) FROM usr""",
        "i01_ingest": f"{_WL} SELECT id, name, color, username, admin, relevant FROM usr",
        "c01_cached": f"""{_WL}
SELECT userId AS user_id, projectId AS project_id, p.name AS project, {_SUM} AS hours
FROM fact JOIN project p ON p.id = projectId WHERE {_IN_YEAR} GROUP BY 1, 2, 3""",
        "c01_hit": f"""{_WL}
SELECT CAST(year(dateStamp) AS INTEGER) AS year, {_SUM} AS hours, 0 AS moved FROM fact GROUP BY 1
UNION ALL
SELECT CAST(year(dateStamp + 365) AS INTEGER), {_SUM}, 1 FROM fact GROUP BY 1""",
        "p04_month_deleted": f"""{_WL}
SELECT CAST(year(dateStamp) AS INTEGER) AS year, count(*) AS entries, {_SUM} AS hours, CAST(year(dateStamp) = 1997 AS INTEGER) AS written
FROM fact WHERE NOT (year(dateStamp) = 1997 AND month(dateStamp) = 3) GROUP BY 1, 4""",
        "p48_projects_deleted": f"""{_WL},
ends AS (SELECT min(projectId) AS a, max(projectId) AS b FROM fact WHERE {_IN_YEAR}),
gone AS (SELECT unnest([a, (a + b) // 2, b]) AS id FROM ends),
hit AS (SELECT DISTINCT year(dateStamp) AS y FROM fact WHERE projectId IN (SELECT id FROM gone))
SELECT CAST(year(dateStamp) AS INTEGER) AS year, count(*) AS entries, {_SUM} AS hours,
  CAST(year(dateStamp) IN (SELECT y FROM hit) AS INTEGER) AS written
FROM fact WHERE projectId NOT IN (SELECT id FROM gone) GROUP BY 1, 4""",
        "p04_published": f"""SELECT date, count(*) AS entries, CAST(sum(hours) AS BIGINT) AS hours FROM ({_log_after_walk()}) GROUP BY 1""",
    }
