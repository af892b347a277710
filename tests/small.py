"""Small hand-made tables."""

import datetime as dt

from hourloom.schema import DEADLINE, EDIT, FACT, PROJECT, STAGE, STAGE_NAMES, USER, Tables


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def facts(spark, rows):
    """Rows (id, user, project, stage, date text, hours)."""
    return spark.createDataFrame([(i, u, p, s, day(d), h) for i, u, p, s, d, h in rows], FACT)


def edits(spark, rows):
    """Rows (seq, op, user, project, stage, date text, hour); ts follows seq."""
    return spark.createDataFrame(
        [
            (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=q), q, op, u, p, s, day(d), h)
            for q, op, u, p, s, d, h in rows
        ],
        EDIT,
    )


def users(spark, rows):
    """Rows (id, name, colour)."""
    return spark.createDataFrame([(i, n, c, f"login{i}", 0, 1) for i, n, c in rows], USER)


def projects(spark, rows):
    """Rows (id, name, square, level, is done)."""
    return spark.createDataFrame(
        [(i, n, q, lv, day("2023-01-01"), done) for i, n, q, lv, done in rows], PROJECT
    )


def stages(spark, extra=()):
    return spark.createDataFrame([*enumerate(STAGE_NAMES, start=1), *extra], STAGE)


def tables(spark, fact=(), user=None, project=None, deadline=(), stage=None) -> Tables:
    return Tables(
        fact=facts(spark, fact) if isinstance(fact, (list, tuple)) else fact,
        project=project
        or projects(spark, [(1, "Дом", 50, 3, 0), (2, "Офис", 80, 5, 1), (3, "Пустой", None, 1, 0)]),
        deadline=spark.createDataFrame(
            [(p, s, d and day(d)) for p, s, d in deadline], DEADLINE
        ),
        stage=stage or stages(spark),
        user=user
        or users(
            spark,
            [(1, "Ann Lee", "0.9,0.3,0.5,1"), (2, "Bob", "0.5,0.5,0.5,1"), (3, "Cy Dent", None)],
        ),
    )


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return [tuple(r) for r in df.collect()]


def bag(df, *columns):
    return sorted(rows(df, *columns), key=lambda r: tuple((v is None, str(v)) for v in r))
