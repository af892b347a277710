"""Op 3, URL filters: rules first, then a character language-model ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.common import LOWER, UPPER, keys128, spread_join, stored, table, whole

#: (action, host and path): fits the host and its subdomains where the path starts so.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
CONTEXT = 3  # longest context of the Markov models
SYMBOLS = LOWER + "0./:?=&#_-%~+"  # digits fold to 0, anything else to *
ALPHABET = len(SYMBOLS) + 3  # with *, the start ^ and the end $
START, END = "^" * CONTEXT, "$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from
    there up to `?`, `#` or the end. Null, or no `://`: both empty."""
    url = whole(url)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(authority, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its action; null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def exploded(urls: DataFrame, *keep: Column) -> DataFrame:
    """(keep ..., gram): a url's character grams, each symbol and the end behind its `CONTEXT`
    symbols. They come from an array of symbols that is made once per url, in a step of its
    own, so the cost is linear for a very long url."""
    folded = F.translate(whole(F.col("url")), UPPER, LOWER)
    folded = F.regexp_replace(folded, "[0-9]", "0")
    folded = F.regexp_replace(folded, r"(?s)[^a-z0./:?=&#_\-%~+]", "*")
    chars = F.split(F.concat(F.lit(START), folded, F.lit(END)), "")
    made = urls.select(*keep, chars.alias("chars"), (F.length("url") + 1).alias("grams"))
    names = [c for c in made.columns if c not in ("chars", "grams")]
    gram = F.transform(
        F.sequence(F.lit(1), F.col("grams")),
        lambda i: F.concat(*[F.element_at("chars", i + k) for k in range(CONTEXT + 1)]),
    )
    return made.select(*names, F.explode(gram).alias("gram"))


def gram_counts(urls: DataFrame, sides: dict[str, Column]) -> DataFrame:
    """(gram, one count per side) of all grams of the urls (url, n rows, ...). There are at
    most ALPHABET ** (CONTEXT + 1) grams, about 3.4 million, however many urls there are."""
    each = exploded(urls, *[F.when(c, F.col("n")).alias(s) for s, c in sides.items()])
    return each.groupBy("gram").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sides])


def probabilities(counts: DataFrame, sides: list[str]) -> DataFrame:
    """(gram, p_<side> ...): P(symbol | context) under each side's urls.

    Counts of shorter grams are sums over the longest ones. Each order is interpolated with
    the next shorter one by the number of distinct continuations of its context
    (Witten-Bell); below the empty context lies the uniform distribution. Tables of up to
    `CONTEXT` symbols have at most ALPHABET ** CONTEXT rows, about 80,000, and are broadcast.
    """
    out = counts
    for s in sides:
        out = out.withColumn(f"p_{s}", F.lit(1.0 / ALPHABET))
    for order in range(CONTEXT + 1):
        tail = F.substring("gram", CONTEXT - order + 1, order + 1)
        level = counts.groupBy(tail.alias("tail")).agg(*[F.sum(s).alias(f"n_{s}") for s in sides])
        heads = level.groupBy(F.substring("tail", 1, order).alias("head")).agg(
            *[F.sum(f"n_{s}").alias(f"all_{s}") for s in sides],
            *[F.count(F.when(F.col(f"n_{s}") > 0, 1)).alias(f"kinds_{s}") for s in sides],
        )
        out = out.withColumn("tail", tail).withColumn("head", F.substring("tail", 1, order))
        if order < CONTEXT:
            out = out.join(F.broadcast(level), "tail")
        else:
            out = out.withColumns({f"n_{s}": F.col(s) for s in sides})
        out = out.join(F.broadcast(heads), "head")
        for s in sides:
            n, total, kinds = F.col(f"n_{s}"), F.col(f"all_{s}"), F.col(f"kinds_{s}")
            mixed = (n + kinds * F.col(f"p_{s}")) / (total + kinds)
            out = out.withColumn(f"p_{s}", F.when(total > 0, mixed).otherwise(F.col(f"p_{s}")))
        out = out.select("gram", *sides, *[f"p_{s}" for s in sides])
    return out.select("gram", *[f"p_{s}" for s in sides])


def threshold(scored: DataFrame) -> float:
    """Where the score separates calibration urls (score, accepted): between the two means,
    nearer to the one with less spread. 0 if either side is missing. One row is collected."""
    side = F.col("accepted")
    got = scored.agg(
        F.avg(F.when(side, F.col("score"))).alias("ma"),
        F.avg(F.when(~side, F.col("score"))).alias("mr"),
        F.stddev_pop(F.when(side, F.col("score"))).alias("sa"),
        F.stddev_pop(F.when(~side, F.col("score"))).alias("sr"),
    ).first()
    if got.ma is None or got.mr is None:
        return 0.0
    if not got.sa + got.sr:
        return (got.ma + got.mr) / 2
    return (got.ma * got.sr + got.mr * got.sa) / (got.sa + got.sr)


def url_filter(df: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Every row of `df` as a struct `row`, with `host`, `path`, `rule`, `score`, `verdict`.

    The longest fitting rule decides. Urls of allow rules train the model of accepted urls,
    those of block rules that of rejected ones, all of them, whole. A url without a rule is
    allowed if its length-normalised log-likelihood difference reaches the threshold, which
    is calibrated on one in five of the labelled urls (by their hash) with models of the
    other four; the final models use all.

    A null url counts as empty: its host and path are empty and its score is that of the end
    symbol alone. Equal urls share a score. Without labelled urls every score is 0 and all
    urls are allowed. Columns of `df` pass in `row`, whatever their names; an empty table
    gives no rows. A hot url is scored once; its rows meet the score in a join that Spark
    splits.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    name, action = rule_for(F.col("host"), F.col("path"), rules)
    rows = (
        df.select(F.struct("*").alias("row"), url.alias("url"))
        .withColumn("host", host)
        .withColumn("path", path)
        .withColumn("rule", name)
        .withColumn("action", action)
    )
    u1, u2 = keys128(whole(F.col("url")))
    keyed = rows.withColumn("u1", u1).withColumn("u2", u2)
    # Each distinct url once, with its rows as a weight.
    urls = stored(
        keyed.groupBy("u1", "u2").agg(
            F.count("*").alias("n"),
            F.first(whole(F.col("url"))).alias("url"),
            F.first("action").alias("action"),
        ),
        "urls",
    )
    accepted = F.col("action") == "allow"
    held_out = F.pmod(F.col("u2"), F.lit(5)) == 0
    sides = {
        "accept": accepted,
        "reject": ~accepted,
        "accept_part": accepted & ~held_out,
        "reject_part": ~accepted & ~held_out,
    }
    counts = stored(gram_counts(urls, sides), "url-grams")
    p = probabilities(counts, list(sides))
    ratios = p.select(
        "gram",
        (F.log("p_accept") - F.log("p_reject")).alias("ratio"),
        (F.log("p_accept_part") - F.log("p_reject_part")).alias("ratio_part"),
    )
    each = exploded(urls, *map(F.col, ("u1", "u2", "n", "action")))
    # Bounded by the number of grams, see `gram_counts`.
    scored = stored(
        each.join(F.broadcast(ratios), "gram")
        .groupBy("u1", "u2", "n", "action")
        .agg(F.avg("ratio").alias("score"), F.avg("ratio_part").alias("score_part")),
        "url-scores",
    )
    check = scored.filter(F.col("action").isNotNull() & held_out)
    cut = threshold(check.select(F.col("score_part").alias("score"), accepted.alias("accepted")))
    guess = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return spread_join(keyed, scored.select("u1", "u2", "score"), ["u1", "u2"]).select(
        "row", "host", "path", "rule", "score", F.coalesce("action", guess).alias("verdict")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")
