"""Several readings of a page: the best one, completed by lines of the others."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What shows a tariff code, a French VAT number, an amount, and an amount that is surely one.
_ISO = "EUR USD GBP CHF CAD JPY KRW HKD NOK TWD THB AUD AED SGD".split()
_MONEY = "(?:" + "|".join([*_ISO, "€", "£", r"\$"]) + ")"
CODE = r"(?U)\b\d{4}[ .]?\d{2}[ .]?\d{2,4}\b"
VAT = r"(?U)\bFR\s?[0-9A-Z]{2}\s?\d{9}\b"
MONEY = rf"(?iU)\b\d[\d., ]*[.,]\d{{2}}\s*{_MONEY}|\b{_MONEY}\s*\d[\d., ]*|TOTAL[^\n]{{0,50}}\d"
SURE_MONEY = rf"(?iU)\b\d[\d., ]*[.,]\d{{2}}\b|\b(?:{'|'.join(_ISO)})\b"
#: The line between a reading and what others add to it; shorter lines (in letters and digits) are never added.
ADDED, LEAST = "[COMPLEMENT OCR]", 6
#: Line ends.
_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def kinds(sirens: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(what shows that a reading has the kind, what shows that a line is of it), one pair a kind."""
    vat = "|".join([VAT, *sirens])
    return [(CODE, CODE), (vat, vat), (MONEY, SURE_MONEY)]


def line_key(line: Column) -> Column:
    return F.regexp_replace(F.upper(line), "[^A-Z0-9]", "")


def lines(rows: DataFrame, text: str) -> DataFrame:
    """rows with a row for each line: line_no from 0, line and its key, in place of the text."""
    out = rows.select(*(c for c in rows.columns if c != text), F.posexplode(F.split(F.col(text), _ENDS)).alias("line_no", "line"))
    return out.withColumn("line_key", line_key(F.col("line")))


def merge_readings(readings: DataFrame, key: str, order: str, score: str, text: str, sirens: Iterable[str] = ()) -> DataFrame:
    """(key, order, text, n_added): of each key the reading of highest score, the first of equal ones, and after a marker the lines of
    the others that are of a kind which it lacks.

    Others' lines come in the order of the readings and of their lines, each once by its letters and digits, and none that the
    best one has: an anti join. A kind that the best reading shows at all is never added to. Null texts count as empty; a key
    whose readings tie in order, too, takes one of them.
    """
    rows = readings.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(score).alias("score"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    best = rows.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "order", "text")).alias("b")).select("key", F.col("b.order").alias("best"), F.col("b.text").alias("best_text"))
    gates = kinds(sirens)
    lacks = [(~F.upper("best_text").rlike(shown)).alias(f"lacks_{i}") for i, (shown, _) in enumerate(gates)]
    wanted = best.select("key", "best", *lacks).filter(" or ".join(f"lacks_{i}" for i in range(len(gates))))
    others = lines(rows.drop("score").join(wanted, "key").filter("order <> best"), "text")
    up, useful = F.upper("line"), F.lit(False)
    for i, (_, shown) in enumerate(gates):
        useful = useful | (F.col(f"lacks_{i}") & up.rlike(shown))
    others = others.filter(useful & (F.length("line_key") >= LEAST))
    new = others.join(lines(best.select("key", F.col("best_text").alias("text")), "text").select("key", "line_key").distinct(), ["key", "line_key"], "left_anti")
    once = new.groupBy("key", "line_key").agg(F.min(F.struct("order", "line_no", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("line"))).alias("l"))
    added = once.groupBy("key").agg(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]).alias("added"))
    whole = F.when(F.col("added").isNull(), F.col("best_text")).otherwise(F.concat_ws("\n", "best_text", F.lit(ADDED), F.array_join("added", "\n")))
    return best.join(added, "key", "left").select(F.col("key").alias(key), F.col("best").alias(order), whole.alias(text), F.when(F.col("added").isNull(), 0).otherwise(F.size("added")).alias("n_added"))
