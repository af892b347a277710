"""Op 1, line dedup: lines that spread over many sites are boilerplate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import LOWER, UPPER, keys128, spread_join, stored, table, whole

MIN_SITES = 3
MIN_WORDS = 5
MIN_CHARS = 20  # of a line without blanks, which counts as `MIN_WORDS` words then
SHORT_CHARS = 12  # of a line of fewer words; below it a line never counts
SHORT_FACTOR = 4  # a short line must be on so many times as many sites
SKETCH_K = 8  # HyperLogLog registers: 2 ** SKETCH_K


def near_band(min_sites: int, sketch_k: int = SKETCH_K, least: float = 1.0) -> float:
    """Distance from the threshold within which an estimate is not trusted: four standard
    errors, at least one site."""
    return max(least, 4 * 1.04 / math.sqrt(2**sketch_k) * min_sites)


def normalised(df: DataFrame, column: str) -> DataFrame:
    """`column` with A-Z lower-cased and, in each line, white space trimmed and runs of it made
    one blank. Done on the whole text; texts that have no such runs skip the patterns."""
    simple = F.translate(F.col(column), UPPER + "\t\x0b\x0c\r", LOWER + "    ")
    out = df.withColumn(column, simple)
    text = F.col(column)
    odd = text.startswith(" ") | text.endswith(" ")
    for part in ("  ", " \n", "\n "):
        odd = odd | text.contains(part)
    tidy = F.trim(F.regexp_replace(F.regexp_replace(text, " *\n *", "\n"), " +", " "))
    return out.withColumn(column, F.when(odd, tidy).otherwise(text))


def line_occurrences(
    df: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int, min_sites: int
) -> DataFrame:
    """One narrow row per line that may count: document key (d1, d2), id, site, position in
    the document, the line's key (h1, h2) and how many sites make it boilerplate (`least`)."""
    text = whole(F.col(f"`{text_col}`"))
    docs = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("site"),
        *[k.alias(n) for k, n in zip(keys128(F.col(f"`{id_col}`"), text), ("d1", "d2"))],
        text.alias("norm"),
    )
    lines = F.posexplode(F.split("norm", "\n")).alias("pos", "line")
    each = normalised(docs, "norm").select("id", "site", "d1", "d2", lines)
    chars = F.length("line")
    blanks = chars - F.length(F.replace("line", F.lit(" ")))
    whole_line = (blanks >= min_words - 1) | ((blanks == 0) & (chars >= MIN_CHARS))
    least = F.when(whole_line, min_sites).when(chars >= SHORT_CHARS, min_sites * SHORT_FACTOR)
    each = each.withColumn("least", least).filter("least IS NOT NULL")
    h1, h2 = keys128(F.col("line"))
    return each.select("id", "site", "d1", "d2", "pos", h1.alias("h1"), h2.alias("h2"), "least")


def boilerplate_lines(lines: DataFrame, sketch_k: int = SKETCH_K) -> DataFrame:
    """Keys of the lines seen on `least` sites or more, with their first occurrence.

    A HyperLogLog sketch per line merges over partitions. Clear estimates decide; lines near
    the threshold get an exact distinct count over their own occurrences.
    """
    first = F.min(F.struct("id", "d1", "d2", "pos")).alias("first")
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(sketch_k))).alias("sites"),
        first,
        F.max("least").alias("least"),
    )
    # Four standard errors, at least one site.
    band = F.greatest(F.col("least") * near_band(1, sketch_k, 0.0), F.lit(1.0))
    sketched = sketched.withColumn("band", band)
    spread = stored(sketched.filter(F.col("sites") >= F.col("least") - F.col("band")), "line-spread")
    clear = spread.filter(F.col("sites") > F.col("least") + F.col("band"))
    near = spread.filter(F.col("sites") <= F.col("least") + F.col("band"))
    pairs = spread_join(lines, near.select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = (
        pairs.groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.sum("one").alias("n"))
    )
    sure = near.join(exact, ["h1", "h2"]).filter("n >= least")
    return clear.select("h1", "h2", "first").unionByName(sure.select("h1", "h2", "first"))


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """All rows and columns of `df`, boilerplate lines taken out of the text, in a struct
    `row`, with `n_lines` and `n_removed` beside it.

    Lines are what `\\n` separates. They are compared after lower-casing A-Z, trimming and
    joining runs of white space. A line of `min_words` words or more, or of `MIN_CHARS`
    characters without a blank (scripts that write none), is boilerplate on `min_sites`
    distinct sites; a shorter one of at least `SHORT_CHARS` characters on `SHORT_FACTOR` times
    as many; what is shorter still, as brackets and blank lines, never is. Its first occurrence (smallest id, then
    position) stays, all others go. So what many documents share stays once, and of a group
    of copies the first keeps its text. The other lines keep their bytes.

    A null text has no line and stays null; an empty text is one empty line. Null and empty
    sites are one site. Null ids come first. Rows that repeat both id and text are one
    document. Other columns, whatever their names, pass unchanged; an empty table stays
    empty. Text is scanned twice and shuffles once, to meet the positions that go.
    """
    found = line_occurrences(df, id_col, text_col, site_col, min_words, min_sites)
    lines = stored(found, "lines")
    bad = boilerplate_lines(lines)
    here = F.struct("id", "d1", "d2", "pos")
    gone = (
        lines.join(bad, ["h1", "h2"])
        .filter(here != F.col("first"))
        .groupBy("d1", "d2")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    text = F.col(f"`{text_col}`")
    keys = [k.alias(n) for k, n in zip(keys128(F.col(f"`{id_col}`"), whole(text)), ("k1", "k2"))]
    others = [F.col(f"`{c}`") for c in df.columns]
    packed = df.select(F.struct(*others).alias("row"), text.alias("text"), *keys)
    match = (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2"))
    joined = packed.join(gone, match, "left").withColumn("lines", F.split("text", "\n"))
    # The pieces between the lines that go, so the cost is linear in the lines.
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("gone") + 1),
            lambda k: F.slice(
                F.col("lines"),
                F.element_at("ends", k) + 2,
                F.element_at("ends", k + 1) - F.element_at("ends", k) - 1,
            ),
        )
    )
    cut = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(pieces, "\n"))
    return joined.withColumn("ends", ends).select(
        F.col("row").withField(f"`{text_col}`", cut).alias("row"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs).select("row.doc_id", "row.text", "n_lines", "n_removed")


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
n AS (
  SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
b AS (SELECT *, length(norm) - length(replace(norm, ' ', '')) AS blanks FROM n),
c AS (
  SELECT *, CASE WHEN blanks >= {MIN_WORDS - 1} OR (blanks = 0 AND length(norm) >= {MIN_CHARS}) THEN {MIN_SITES}
    WHEN length(norm) >= {SHORT_CHARS} THEN {MIN_SITES * SHORT_FACTOR} END AS least FROM b),
s AS (
  SELECT norm, count(DISTINCT coalesce(source, '')) AS sites,
    min((doc_id, pos)) AS first
  FROM c WHERE least IS NOT NULL GROUP BY norm),
g AS (
  SELECT c.*, coalesce(sites >= least AND (doc_id, pos) <> first, false) AS gone
  FROM c LEFT JOIN s USING (norm))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL
    ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE count(*) END AS n_lines,
  count(*) FILTER (gone) AS n_removed
FROM documents d JOIN g USING (doc_id) GROUP BY d.doc_id, d.text
"""
