"""Importance resampling towards a target distribution: documents that look like a target's text are drawn more often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: A feature: a run of letters and digits of ASCII, or of anything beyond it.
FEATURE_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED = 10_000, 2024
#: Documents with so many words take part; so many of a hundred of them are drawn.
MIN_FEATURES, PERCENT = 20, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def buckets(text: Column) -> Column:
    """The array of a text's buckets, one for each of its words with repeats; a null text has none."""
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(FEATURE_PATTERN), F.lit(0))
    numbers = F.transform(words, lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("int"))
    return F.coalesce(numbers, F.array().cast("array<int>"))


def gains(raw: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket, from two frames with a column b of bucket arrays: floor(1000 ln of the smoothed shares' ratio).

    Counts are summed within tasks first, so that at most BUCKETS totals a task and side are shuffled; BUCKETS rows reach the driver.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    every = raw.select(F.explode("b").alias("bucket"), one.alias("s"), none.alias("t")).unionAll(target.select(F.explode("b").alias("bucket"), none.alias("s"), one.alias("t")))
    rows = every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    held = {r["bucket"]: (r["s"], r["t"]) for r in rows}
    s, t = (sum(x[k] for x in held.values()) for k in (0, 1))
    counts = raw.sparkSession.range(BUCKETS).coalesce(1).select("id", *(F.element_at(_literal([held.get(b, (0, 0))[k] for b in range(BUCKETS)], "bigint"), (F.col("id") + 1).cast("int")).cast("double").alias(n) for k, n in enumerate("st")))
    ratio = (F.col("t") + 1) * (F.lit(float(s)) + BUCKETS) / ((F.col("s") + 1) * (F.lit(float(t)) + BUCKETS))
    return [r[0] for r in counts.orderBy("id").select(F.floor(1000 * F.log(ratio)).cast("long")).collect()]


def _literal(values: list[int], kind: str) -> Column:
    """An array literal: the optimiser folds the cast of one string, which is quicker than an expression a value."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)")


def noise(doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)), with u from the id's SHA-256; a null id counts as an empty string."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, order: list[Column], most: Column | int) -> DataFrame:
    """rows and a long column rank: 1, 2, 3, ... in that order, null beyond most. No task holds more than its range of the order.

    Rows are dealt by ranges and sorted, and written with their place in their part; a part's ranks begin after the counts of the
    parts before it, of which there is one row a part. Rows that tie in the order should be equal.
    """
    shift = 33  # bits of a row's number below its part's in monotonically_increasing_id
    k = F.monotonically_increasing_id()
    ordered = materialise(rows.repartitionByRange(*order, F.col("row")).sortWithinPartitions(*order, F.col("row")).drop("row").withColumn("k", k), "ordered")
    part = F.shiftright("k", shift)
    n = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(n):
        before[p] = total
        total += n[p]
    if not n:
        return ordered.withColumn("rank", F.lit(None).cast("long")).drop("k")
    base = F.element_at(_literal([before.get(p, 0) for p in range(max(n) + 1)], "bigint"), (part + 1).cast("int"))
    rank = base + F.col("k").bitwiseAND((1 << shift) - 1) + 1
    return ordered.withColumn("rank", F.when(rank <= most, rank)).drop("k")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least: int = MIN_FEATURES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs.

    weight sums, over a document's words, the gains of their buckets; score adds Gumbel noise of the id, so that the percent
    highest scores among documents with at least `least` words are a draw without replacement in proportion to exp(weight / 1000).
    A document's words stay in one array: scoring explodes nothing and shuffles nothing, and the gains are a literal in the plan.
    Texts are read twice, to count and to score; after that only the five numbers of a row move.

    Null and empty texts have no words, weight 0, and are not drawn. A null id scores as an empty string and is ranked before
    others on ties. Rows that repeat an id have their own weights and are drawn one by one; equal rows are interchangeable. Very long
    texts cost an array of 4 bytes a word. An empty table gives an empty result; an empty target gives gains from docs alone.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), buckets(F.col(f"`{text_col}`").cast("string")).alias("b"))
    gain = _literal(gains(plain.select("b"), target.select(buckets(F.col(f"`{target_col}`").cast("string")).alias("b"))), "bigint")
    total = F.aggregate("b", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    scored = plain.select("doc_id", F.size("b").cast("long").alias("n_features"), total.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored = materialise(scored, "scored")
    many = F.col("n_features") >= least
    drawn = percent * scored.filter(many).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    # what ties in all five numbers is divided among parts by its row
    eligible = ranked(scored.filter(many).withColumn("row", F.monotonically_increasing_id()), order, drawn)
    rest = scored.filter(~many).withColumn("rank", F.lit(None).cast("long"))
    return eligible.unionByName(rest)


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    """The whole documents table towards the benchmark's texts."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Words are reduced to their bytes' CRC-32 by the table of the reversed polynomial, once a distinct word.
ORACLE_SQL = rf"""
WITH e AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, i::BIGINT)) AS crc),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{FEATURE_PATTERN}') AS words FROM documents),
r AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{FEATURE_PATTERN}') AS words FROM benchmark),
dw AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(words) AS w FROM d) GROUP BY k, w),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM r) GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
b AS (SELECT w, (xor(4294967295::BIGINT, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(crc[1 + xor(c % 256, y)], c // 256), 4294967295::BIGINT)) % {BUCKETS})::INT AS bucket FROM h, e),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM tw JOIN b USING (w) GROUP BY bucket),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) AS x(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
w AS (SELECT k, sum(n * gain)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY k),
c AS (SELECT k, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (k)),
m AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_FEATURES} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_FEATURES} AND place <= {PERCENT} * (SELECT count(*) FROM c WHERE n_features >= {MIN_FEATURES}) // 100 THEN place END AS rank FROM m
"""
