"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is a that for it with as was on are be by this at from
der die das und ist nicht von zu den mit ein eine im auf sich des dem für
le la les de des et un une en que qui est pour dans sur au du par avec pas
el los las y en que es por con una para del se no su al lo como
""".split()

#: (measure, comparison that rejects, threshold). A text is kept when no rule rejects it. Measures are ratios of the counts below.
RULES = [
    ("symbols_per_word", ">", 0.1),  # each bar that joins fragments is a word, too, so that even these stay below 0.5
    ("mean_word_length", ">", 25.0),
    ("mean_word_length", "<", 2.0),
    ("dup_line_ratio", ">", 0.5),
    ("stop_word_ratio", "<", 0.005),
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _starts_of_repeats(s: Column) -> Column:
    """From (hash, position) pairs in hash order: the positions in order whose hash has an equal neighbour."""
    n = F.size(s)
    same = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a["h"] == b["h"])
    no = F.array(F.lit(False))
    held = F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b)
    hits = F.zip_with(s, held, lambda a, b: F.when(b, a["p"]))
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.array_sort(F.filter(hits, lambda x: x.isNotNull())))


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of a width that begin at the ordered starts."""
    zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(width), p - a["last"])).alias("sum"))
    return F.aggregate(starts, zero, step, lambda a: a["sum"])


def quality_counts(docs: DataFrame, text_col: str = "text", name: str = "q") -> DataFrame:
    """docs and a struct column of that name: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines.

    Each step is a projection of its own, so that the optimiser keeps the word array and the sorted windows as columns.
    A null text counts as empty: all counts are 0. Repeated rows are counted alike.
    """
    text, w, s, t = F.col(text_col).cast("string"), *(free_name(docs, f"{name}_{x}") for x in "wst")
    out = docs.withColumn(w, _words(text))
    words = F.col(w)
    n = F.size(words)
    windows = F.zip_with(F.zip_with(F.slice(words, 1, n - 2), F.slice(words, 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(words, 3, n - 2), lambda x, c: F.xxhash64(x["a"], x["b"], c))
    out = out.withColumn(s, F.when(n >= 3, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    out = out.withColumn(t, F.coalesce(_starts_of_repeats(F.col(s)), F.array().cast("array<int>")))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD_PATTERN))
    stops = F.filter(words, lambda x: F.lower(F.rtrim(x, F.lit(",.!?;:"))).isin(STOP_WORDS))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col(t), 3).alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return out.withColumn(name, counts).drop(w, s, t)


def quality_verdict(q: str) -> tuple[Column, Column]:
    """(base_failed, kept) as Columns from the struct of counts; the rule table becomes one boolean expression."""
    c = lambda x: F.col(q)[x]
    one = F.greatest(c("n_words"), F.lit(1))
    measures = {
        "symbols_per_word": c("n_symbols") / one,
        "mean_word_length": c("word_chars") / one,
        "dup_line_ratio": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "stop_word_ratio": c("n_stop_words") / one,
    }
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    bad = F.lit(False)
    for measure, way, threshold in RULES:
        bad = bad | (measures[measure] > threshold if way == ">" else measures[measure] < threshold)
    return failed, ~failed & ~bad


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text passes RULES, with the columns of docs. Null and empty texts are rejected (no words)."""
    q, row = free_name(docs, "quality"), free_name(docs, "quality_row")
    # A predicate would sink below the projections and there repeat the counts at each use; a column that is not
    # deterministic keeps it above them.
    counted = quality_counts(docs, text_col, q).withColumn(row, F.monotonically_increasing_id())
    return counted.filter(quality_verdict(q)[1] & (F.col(row) >= 0)).drop(q, row)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row; a null text counts as empty."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    failed, kept = quality_verdict("q")
    return quality_counts(plain).select("doc_id", *(f"q.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), kept.alias("kept"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The rules over the whole documents table."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_BAD = " OR ".join(f"{m} {way} {x}" for m, way, x in RULES)

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT k, unnest(words) AS x, generate_subscripts(words, 1) AS p FROM w),
t AS (SELECT k, p, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM g WINDOW o AS (PARTITION BY k ORDER BY p)),
c AS (SELECT k, p, count(*) OVER (PARTITION BY k, x, y, z) AS c FROM t WHERE z IS NOT NULL),
r AS (SELECT k, count(DISTINCT q) AS n_repeat_words FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM c WHERE c > 1) GROUP BY k),
s AS (SELECT k, count(*) AS n_stop_words FROM g WHERE lower(rtrim(x, ',.!?;:')) IN ({_STOPS}) GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN r USING (k) LEFT JOIN s USING (k) LEFT JOIN l USING (k)),
v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS symbols_per_word, word_chars / greatest(n_words, 1) AS mean_word_length,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_stop_words / greatest(n_words, 1) AS stop_word_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_BAD}) AS kept FROM v
"""
