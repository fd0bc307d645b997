"""URL filters: rules by host and path, and for the rest the ratio of two character language models.

DataFrame and SQL functions only. Both models are smoothed variable-order Markov models over an alphabet of 32 symbols, so
that a model has at most 32**4 rows whatever the number of URLs: that bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.llm.common import forget, read, stored

#: Rules (verdict, host, path). A rule fits its host and all below it, where the path starts with its own; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Symbols: a to z, 0 for digits, dot, slash, hyphen, _ for all else, ^ before and $ after. Longest context.
ALPHABET, ORDER = 32, 3
#: Of URLs with a verdict by rule, every HELD_OUT-th is kept from the models to calibrate the threshold, in steps of 1 / STEPS.
HELD_OUT, STEPS, WIDEST = 5, 50, 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _fits(rule: tuple[str, str, str], h: Column, p: Column) -> Column:
    return ((h == rule[1]) | h.endswith(f".{rule[1]}")) & p.startswith(rule[2])


def by_rules(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """urls (with host and path) and rule and listed, the verdict of the longest rule that fits, else null. Rules are a short list of settings."""
    out = urls.withColumns({"rule": F.lit(None).cast("string"), "listed": F.lit(None).cast("string")})
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(r, F.col("host"), F.col("path"))
        out = out.withColumns({"rule": F.when(fits, r[1] + r[2]).otherwise(F.col("rule")), "listed": F.when(fits, r[0]).otherwise(F.col("listed"))})
    return out


def shape(url: Column) -> Column:
    """A URL in the alphabet of the models: what follows :// or, without it, all; query and fragment included; digits in a row as one."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    lowered = F.translate(rest, _UPPER, _LOWER)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(F.regexp_replace(lowered, "[0-9]+", "0"), "[^a-z0./-]", "_"), F.lit("$"))


def grams(shapes: DataFrame) -> DataFrame:
    """One row for each symbol of each shape, g: the symbol after its longest context."""
    last = F.length("shape") - ORDER
    return shapes.withColumn("i", F.explode(F.sequence(F.lit(1), last))).withColumn("g", F.col("shape").substr(F.col("i"), F.lit(ORDER + 1))).drop("i")


def model(counted: DataFrame) -> DataFrame:
    """g, llr: for every gram the difference of both models' log probabilities of its symbol.

    counted has g and how often each class has it, n_allow and n_block. Witten-Bell interpolation: an order's estimate and
    that of the next shorter context are mixed by how many different symbols the context has had, so each context is
    used as far as its counts bear. Below order 0 all symbols are as likely.
    """
    out = counted
    for cls in ("allow", "block"):
        lower: Column = F.lit(1.0 / ALPHABET)
        for order in range(ORDER + 1):
            tail = F.col("g").substr(ORDER + 1 - order, order + 1)
            table = counted.groupBy(tail.alias("tail")).agg(F.sum(f"n_{cls}").alias("n"))
            context = Window.partitionBy(F.col("tail").substr(1, order)) if order else Window.partitionBy(F.lit(0))
            table = table.withColumn("all", F.sum("n").over(context)).withColumn("kinds", F.sum((F.col("n") > 0).cast("long")).over(context))
            names = [f"{x}_{cls}_{order}" for x in ("tail", "n", "all", "kinds")]
            out = out.join(table.toDF(*names), tail == F.col(names[0])).drop(names[0])
            n, total, kinds = map(F.col, names[1:])
            lower = F.when(total > 0, (n + kinds * lower) / (total + kinds)).otherwise(lower)
        out = out.withColumn(f"log_{cls}", F.log(lower))
    return out.select("g", (F.col("log_allow") - F.col("log_block")).alias("llr"))


def scores(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """shapes (shape, listed) with score, the log-likelihood difference for each symbol; and the threshold, a table of one row.

    The threshold is that which, on held-out URLs with a verdict by rule, gives the best mean of both classes' recalls; of equally
    good ones that nearest 0. Without such URLs it is 0.
    """
    held = F.pmod(F.xxhash64("shape"), F.lit(HELD_OUT)) == 0
    seen = grams(shapes)
    counts = [F.sum(F.when((F.col("listed") == c) & ~held, 1).otherwise(0)).alias(f"n_{c}") for c in ("allow", "block")]
    counted = stored(seen.groupBy("g").agg(*counts), "grams")
    fitted = stored(model(counted), "llr")
    # At most ALPHABET ** (ORDER + 1) rows, about a million.
    each = seen.join(F.broadcast(fitted), "g").groupBy("shape", "listed").agg((F.sum("llr") / F.count("*")).alias("score"))
    scored = stored(each, "scores")
    forget(counted, fitted)
    bins = F.round(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("score"))) * STEPS).cast("int")
    tally = scored.where(held & F.col("listed").isNotNull()).groupBy(bins.alias("bin")).agg(*(F.sum((F.col("listed") == c).cast("long")).alias(c) for c in ("allow", "block")))
    # At most 2 * WIDEST * STEPS + 1 rows.
    above, below, every = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    recall = F.coalesce(F.try_divide(F.sum("allow").over(above), F.sum("allow").over(every)), F.lit(0.0)) + F.coalesce(F.try_divide(F.sum("block").over(below), F.sum("block").over(every)), F.lit(0.0))
    best = tally.withColumn("recall", recall).agg(F.max(F.struct("recall", -F.abs("bin"), "bin"))["bin"].alias("bin"))
    return scored, best.select(F.coalesce((F.col("bin") - 0.5) / STEPS, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url).

    A null url, or one without ://, has an empty host and path and is judged by the models like any other. Null ids stay
    null, repeated rows repeat, other columns are ignored, an empty table gives no rows. The models learn from the URLs
    that rules decide, each shape once, so that no host's many pages outweigh the rest.
    """
    urls = by_rules(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), shape(F.col("url")).alias("shape")), rules)
    # Hosts differ in digits, too; of a shape's verdicts the greater counts.
    shapes = stored(urls.groupBy("shape").agg(F.max("listed").alias("listed")), "shapes")
    scored, threshold = scores(shapes)
    forget(shapes)
    met = urls.join(scored.select("shape", "score"), "shape")
    by_model = F.when(F.col("score") >= threshold.scalar(), "allow").otherwise("block")
    return met.select("page_id", "host", "path", "rule", F.coalesce("listed", by_model).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
