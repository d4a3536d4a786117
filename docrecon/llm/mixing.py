"""Mixing sources to target weights: certain whole copies, then Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, free_name, materialise, word_count

#: The mix holds SHARE times all words; sources in code-point order (null last) weigh WEIGHTS, repeating; no source gets over MOST times its words.
SHARE, WEIGHTS, MOST = 1.5, (3.0, 1.0, 2.0), 2.0
#: Odds of the order sample are looked up in so many bins before exact ranks are taken within the one bin where a source's sample ends.
BINS = 4096
#: Parts of a source where its plan is too large to be broadcast.
SALTS = 64


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size): shares by weight, stopped at MOST times the source, the excess reshared.

    The fixed point is min(cap, weight times one level): in the order of cap per weight, a prefix of sources is stopped.
    Works on one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", MOST * F.col("source_size"))
    rise = W.orderBy(F.col("cap") / F.col("weight"), "k")
    before, after = rise.rowsBetween(W.unboundedPreceding, -1), rise.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("total", SHARE * F.sum("source_size").over(W.partitionBy()))
    per = per.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    per = per.withColumn("stopped", F.col("cap") * F.col("open") <= F.col("weight") * F.col("rest"))
    # the first source in the order that is not stopped sets the level for it and all after it
    per = per.withColumn("level", F.first(F.when(~F.col("stopped"), F.struct("rest", "open")), ignorenulls=True).over(rise.rowsBetween(W.unboundedPreceding, 0)))
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("level.rest") / F.col("level.open")).alias("target"))


def chance(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the values alone: 13 hexadecimal digits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in columns)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def pareto_odds(u: Column, pi: Column) -> Column:
    """The order-sampling rank: random odds over inclusion odds; 0, the first, for what is certain, null for what is never taken."""
    return F.when(pi >= 1, 0.0).when(pi > 0, (u / (1 - u)) / (pi / (1 - pi)))


def _bin(odds: Column) -> Column:
    return F.floor(odds / (1 + odds) * BINS).cast("int")


def weight_of(size: Column) -> Column:
    """What a document's inclusion probability is proportional to within its source: the binary digits of its size, so that longer documents are likelier by the logarithm of their length."""
    return F.length(F.bin(size)).cast("double")


def inclusion(classes: DataFrame) -> DataFrame:
    """From rows (source, g, words, want), one a source and weight, adds pi = min(1, g times the source's level), with pi words adding up to want.

    In the order of falling weight a prefix of classes is certain; the first that is not sets the level. One row a source and weight.
    """
    fall = W.partitionBy("source").orderBy(F.desc("g"))
    before, after = fall.rowsBetween(W.unboundedPreceding, -1), fall.rowsBetween(0, W.unboundedFollowing)
    out = classes.withColumn("rest", F.col("want") - F.coalesce(F.sum("words").over(before), F.lit(0.0))).withColumn("open", F.sum(F.col("g") * F.col("words")).over(after))
    level = F.first(F.when(~(F.col("rest") * F.col("g") >= F.col("open")), F.struct("rest", "open")), ignorenulls=True).over(fall.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("level", level)
    return out.withColumn("pi", F.when(F.col("want") <= 0, 0.0).when(F.col("level").isNull(), 1.0).otherwise(F.col("g") * F.col("level.rest") / F.col("level.open"))).drop("rest", "open", "level")


def _small(side: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(side) if small else side


def _meet(rows: DataFrame, plan: DataFrame, small: bool, source: Column, g: Column, key: Column) -> DataFrame:
    """rows joined with their plan as one struct column, named plan or the next free name. A plan that was counted small is broadcast; a larger one meets each source in SALTS parts."""
    name = free_name(rows, "plan")
    same = source.eqNullSafe(F.col(f"{name}.source")) & (g == F.col(f"{name}.g"))
    side = plan.select(F.struct("*").alias(name))
    if small:
        return rows.join(F.broadcast(side), same)
    salt = free_name(rows, "salt")
    side = side.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return salted.join(side, same & (F.col(salt) == F.col(f"{salt}_"))).drop(salt, f"{salt}_")


def _plan(docs: DataFrame) -> tuple[DataFrame, bool]:
    """From rows (id, source, size, u): (source, g, source_size, target, copies, pi, b, last), where a source's sample is what lies below bin b, or within it up to last; all of it if b is null.

    And whether these rows, one a source and weight, are few enough to be broadcast.
    """
    per = materialise(docs.groupBy("source", weight_of(F.col("size")).alias("g")).agg(F.sum("size").alias("size")), "weights")
    small = per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    targets = source_targets(per)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("copies", F.floor(ratio)).withColumn("want", F.col("target") - F.col("copies") * F.col("source_size")).withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    classes = per.select("source", "g", F.col("size").cast("double").alias("words"))
    classes = materialise(inclusion(classes.join(_small(targets, small), same)), "classes", per)
    met = _meet(docs, classes.filter("pi > 0").select("source", "g", "want", "pi"), small, F.col("source"), weight_of(F.col("size")), F.col("id"))
    ranked = materialise(met.select("source", "id", "size", "plan.want", pareto_odds(F.col("u"), F.col("plan.pi")).alias("odds")).withColumn("bin", _bin(F.col("odds"))), "ranked")
    run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("want").alias("want")).withColumn("below", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = _small(bins.filter("below < want and below + words >= want").select(F.col("source").alias("s"), F.col("bin").alias("b"), "below"), small)
    # within one bin of each source: exact running sums; a row is in if at least half of it lies within what is wanted
    at = W.partitionBy("source").orderBy("odds", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = ranked.join(edge, same & (F.col("bin") == F.col("b"))).withColumn("upto", F.col("below") + F.sum("size").over(at))
    last = inside.filter("2 * upto - size <= 2 * want").groupBy(F.col("source").alias("l")).agg(F.max(F.struct("odds", "id")).alias("last"))
    ends = edge.join(last, F.col("s").eqNullSafe(F.col("l")), "left").select(F.col("s").alias("e"), "b", "last")
    plan = classes.join(_small(ends, small), F.col("source").eqNullSafe(F.col("e")), "left").select("source", "g", "source_size", "target", "copies", "pi", "b", "last")
    return materialise(plan, "plan", classes, ranked), small


def _copies(u: Column, id_: Column, plan) -> Column:
    """Copies of a row given its source's plan (a function from names to Columns): whole ones, and one more if it ranks within the sample."""
    odds = pareto_odds(u, plan("pi"))
    place, bin_ = F.struct(odds.alias("odds"), id_.alias("id")), _bin(odds)
    within = plan("b").isNull() | F.coalesce(bin_ < plan("b"), F.lit(False)) | (F.coalesce(bin_ == plan("b"), F.lit(False)) & F.coalesce(place <= plan("last"), F.lit(False)))
    return (plan("copies") + F.when((plan("pi") > 0) & within, 1).otherwise(0)).cast("int")


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(f"`{text_col}`").alias("size"))
    return materialise(rows.withColumn("u", chance(F.lit("mix"), F.col("id"))), "sizes")


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs.

    Every document gets floor(target / source_size) certain copies. What the target still wants is a Pareto order sample of
    unequal probabilities: a document's is proportional to the binary digits of its size, at most 1, and such that the expected
    words are those wanted. Documents rank by random odds over inclusion odds, and the sample ends where the words wanted are
    reached, so a source misses its target by half a document at most. A null text has size 0; null sources are one source, the
    last. Rows that repeat a doc_id rank alike (ties by doc_id). An empty table gives an empty result.
    """
    rows = _sized(docs, id_col, source_col, text_col)
    joined = _meet(rows, *_plan(rows), F.col("source"), weight_of(F.col("size")), F.col("id"))
    n = _copies(F.col("u"), F.col("id"), lambda x: F.col(f"plan.{x}"))
    return joined.select(F.col("id").alias("doc_id"), "size", F.col("plan.source_size").cast("long").alias("source_size"), F.col("plan.target").alias("target"), (F.col("size") * n).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix_report takes it, with the columns of docs.

    Only the plan, a row for each source and weight, meets the documents: broadcast once it is counted, so that texts are not shuffled.
    """
    sizes = _sized(docs, id_col, source_col, text_col)
    plan, small = _plan(sizes)
    discard(sizes)
    took, name = free_name(docs, "mix_copies"), free_name(docs, "plan")
    own = [F.col(f"`{c}`") for c in docs.columns]
    id_ = F.col(f"`{id_col}`").cast("long")
    joined = _meet(docs, plan, small, F.col(f"`{source_col}`").cast("string"), weight_of(word_count(f"`{text_col}`")), id_)
    n = _copies(chance(F.lit("mix"), id_), id_, lambda x: F.col(f"{name}.{x}"))
    counted_ = joined.select(*own, n.alias(took)).filter(F.col(took) > 0)
    return counted_.withColumn(took, F.explode(F.array_repeat(F.lit(1), F.col(took)))).select(*own)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of the whole documents table."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)!r}::DOUBLE AS u, length(bin(size))::DOUBLE AS g FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
q AS (SELECT *, [{', '.join(f'{w!r}::DOUBLE' for w in WEIGHTS)}][(k % {len(WEIGHTS)} + 1)::INT] AS weight, {MOST!r}::DOUBLE * source_size AS cap FROM p),
r AS (SELECT *, {SHARE!r}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM q),
f AS (SELECT arg_min(rest, (cap / weight, k)) AS rest, arg_min(open, (cap / weight, k)) AS open, min((cap / weight, k)) AS first FROM r WHERE NOT cap * open <= weight * rest),
t AS (SELECT r.source, source_size, CASE WHEN f.first IS NULL OR (cap / weight, k) < f.first THEN cap ELSE weight * f.rest / f.open END AS target FROM r, f),
c AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio, floor(ratio) AS copies, target - copies * source_size AS want FROM t),
k AS (SELECT source, g, sum(size)::DOUBLE AS words FROM d GROUP BY source, g),
m AS (SELECT k.source, k.g, c.source_size, c.target, c.copies, c.want,
    c.want - coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY k.g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(k.g * words) OVER (PARTITION BY k.source ORDER BY k.g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source),
e AS (SELECT source, max(g) AS first, arg_max(rest, g) AS rest, arg_max(open, g) AS open FROM m WHERE NOT rest * g >= open GROUP BY source),
i AS (SELECT m.source, m.g, source_size, target, copies, want, CASE WHEN want <= 0 THEN 0 WHEN e.first IS NULL OR m.g > e.first THEN 1 ELSE m.g * e.rest / e.open END AS pi FROM m LEFT JOIN e ON m.source IS NOT DISTINCT FROM e.source),
o AS (SELECT d.doc_id, d.size, d.source, i.source_size, i.target, i.copies, i.pi, i.want, CASE WHEN pi >= 1 THEN 0 WHEN pi > 0 THEN (d.u / (1 - d.u)) / (pi / (1 - pi)) END AS odds FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source AND d.g = i.g),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN pi > 0 AND 2 * upto - size <= 2 * want THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
