"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values: (host, path, verdict); a rule fits its host and subdomains where the path starts with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The classifier is fitted on about so many distinct labelled URLs at most (those of least hash); statistics of suffixes cover all labelled ones, each share smoothed by SMOOTH URLs of the overall share.
MAX_TRAIN, SMOOTH = 20_000, 10
TREES, DEPTH = 10, 4
FEATURES = ["length", "depth", "digits", "entropy", "params", "labels", "hyphens", "fragment", "secure", "path_length", "host_suffix", "path_suffix"]


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def _rule(host: Column, path: Column) -> Column:
    """A struct (rule, verdict) of the longest fitting rule; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):  # the longest is asked first, as the outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def _features(urls: DataFrame) -> DataFrame:
    """Adds host, path, fit (the rule) and the lexical features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    lower = F.translate(_part(F.col("url"), 1), string.ascii_uppercase, string.ascii_lowercase)
    out = urls.withColumn("host", lower).withColumn("path", _part(F.col("url"), 2))
    host, path = F.col("host"), F.col("path")
    number = lambda c: c.cast("double")
    return out.select(
        "*",
        _rule(host, path).alias("fit"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("top"),
        F.regexp_extract(path, r"(\.[^./]*|/)?$", 0).alias("tail"),
        number(F.length(url)).alias("length"),
        number(F.regexp_count(path, F.lit("/[^/]"))).alias("depth"),
        (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1))).alias("digits"),
        _entropy(url).alias("entropy"),
        number(F.size(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""))).alias("params"),
        number(F.size(F.split(host, r"\."))).alias("labels"),
        number(F.regexp_count(host, F.lit("-"))).alias("hyphens"),
        number(url.contains("#")).alias("fragment"),
        number(url.startswith("https:")).alias("secure"),
        number(F.length(path)).alias("path_length"),
    )


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    URLs that a rule fits are the labelled ones. Suffix features are smoothed shares of blocked URLs among all labelled ones
    with that last host label or path ending; a training URL's own label is left out of its shares. The trees are fitted on
    distinct labelled URLs below a hash threshold set by their count, MAX_TRAIN or fewer. A null URL or one without :// has an
    empty host and path and is judged by the trees. A URL of any length is read whole. With labels of one kind only, that kind
    is every verdict; with none, allow. Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    rows = _features(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")))
    known = rows.filter("fit is not null").withColumn("label", (F.col("fit.verdict") == "block").cast("double"))
    stats = materialise(known.groupBy("top", "tail").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")), "suffixes")
    total = stats.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    if not total["n"] or total["bad"] in (0, total["n"]):
        other = F.lit("block" if total["n"] and total["bad"] else "allow")
        return rows.select("page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", other).alias("verdict"))
    prior = total["bad"] / total["n"]
    for key, name in (("top", "host_suffix"), ("tail", "path_suffix")):
        sums = materialise(stats.groupBy(key).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "suffix")
        own, one = F.coalesce(F.col("label"), F.lit(0.0)), F.when(F.col("label").isNull(), 0).otherwise(1)
        share = (F.coalesce("bad", F.lit(0.0)) - own + SMOOTH * prior) / (F.coalesce("n", F.lit(0)) - one + SMOOTH)
        rows, known = (x.join(sums, key, "left").withColumn(name, share).drop("bad", "n") for x in (rows.withColumn("label", F.lit(None).cast("double")), known))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    part = F.pmod(F.xxhash64("url"), F.lit(1_000_000))
    sample = known.filter(part < int(min(1.0, 0.97 * MAX_TRAIN / total["n"]) * 1_000_000)).dropDuplicates(["url"]).select("label", *FEATURES)
    sample = materialise(sample, "labelled").coalesce(2)
    if sample.select("label").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", F.lit("block" if prior > 0.5 else "allow")).alias("verdict"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(vector.transform(sample).select("label", "features"))
    judged = model.transform(vector.transform(rows))
    verdict = F.coalesce("fit.verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "fit.rule", verdict.alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on every URL of the pages table."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
