"""The total of an invoice's text: labelled amounts, the last of them, checked against the sum of its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import amount, close, let, said

# Currencies and what they are misread as, and labels of a total; tables of totals decide at once, in this order.
CURRENCIES = "EUR USD GBP CHF CAD JPY CNY HKD KRW SGD MXN BRL INR AED SAR AUD NZD NOK SEK DKK TWD THB MYR".split()
MISREAD = {"CHE": "CHF", "CHP": "CHF", "CAO": "CAD", "€": "EUR", "£": "GBP", "¥": "JPY"}
FOOTERS = ["TOTAL AMOUNT", "INVOICE TOTAL", "TOTAL VALUE"]
LABELS = ["TOTAL INVOICE AMOUNT", "TOTAL GOODS VALUE", "TOTAL INCL TAXES", "TOTAL INCL", "RECIPIENT TOTAL EXCL TAXES", "TOTAL", "SUB TOTAL", "VALUE", "INVOICE VALUE", "VALUE FOR CUSTOMS"]
FOOTER_REACH, LABEL_REACH, MOST = 260, 80, 10_000_000.0
PAIR = "struct<currency:string,total:double>"

_NAMES = [*CURRENCIES, *MISREAD]
#: Names of one first letter together: most places of a text begin none.
_CURRENCY = "|".join(k + "(?:" + "|".join(n[1:] for n in _NAMES if n[0] == k) + ")" for k in dict.fromkeys(n[0] for n in _NAMES))
_AMOUNT = r"\d(?:[\d.,]|[ \u00A0](?=\d))*"


def _pair(text: Column) -> Column:
    """(currency, total) from a captured amount with its currency on either side; null unless 0 < total < MOST."""
    aliases = F.create_map(*(F.lit(x) for kv in MISREAD.items() for x in kv))
    name = let(F.upper(F.regexp_extract(text, f"(?i)({_CURRENCY})", 1)), lambda c: F.coalesce(F.try_element_at(aliases, c), c))
    value = let(F.regexp_replace(F.regexp_extract(text, f"({_AMOUNT})", 1), r"[.,\s]+$", ""), lambda v: amount(v, thousands=True))
    return let(F.struct(name.alias("currency"), value.alias("total")), lambda p: F.when((p["total"] > 0) & (p["total"] < MOST), p))


def _pairs(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?i)((?:{_CURRENCY})[^\w\n]{{0,6}}{_AMOUNT}|{_AMOUNT} ?(?:{_CURRENCY}))(?![A-Z])"), F.lit(1))
    return F.filter(F.transform(found, _pair), lambda p: p.isNotNull())


def _after(text: Column, label: str, reach: int, lines: bool, words: Column | None) -> Column:
    """What follows each place of a label, up to reach characters."""
    any_, printed = r"[\s\S]" if lines else r"[^\n]", label.replace(" ", "[ .]+")
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b{printed}\b(?=({any_}{{0,{reach}}}))"), F.lit(1))
    return F.when(said(words, label), found).otherwise(F.array().cast("array<string>"))


def line_sum(text: Column) -> Column:
    """(currency, total): the sum of the amounts of lines that begin with a code of eight to ten digits, if all have one currency.
    An amount with its currency beside it counts before a bare one such as a weight."""
    blocks = F.regexp_extract_all(text, F.lit(r"\b\d{8,10}\b(?=((?:[^\dT]|(?!\b\d{8,10}\b|TOTAL)[\s\S]){0,120}))"), F.lit(1))
    blocks = F.when(text.rlike(r"\d{8}"), blocks).when(text.isNotNull(), F.array().cast("array<string>"))
    per = F.filter(F.transform(blocks, lambda b: F.get(_pairs(b), F.lit(0))), lambda p: p.isNotNull())
    def whole(ps: Column) -> Column:
        names = F.array_distinct(F.transform(ps, lambda p: p["currency"]))
        total = F.round(F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["total"]), 2)
        return F.when(F.size(names) == 1, F.struct(F.get(names, F.lit(0)).alias("currency"), total.alias("total")))

    return let(per, whole)


def choice(text: Column, words: Column | None = None) -> Column:
    """A struct (picked, estimated): (currency, total) and whether it is a sum of lines, which missed ones make too low.

    A footer's pair decides; else the last labelled amount, unless it has the lines' currency and is outside half to one and a
    half of their sum, which then stands; else that sum. picked is null if there is nothing.
    """
    foot = [F.get(F.flatten(F.transform(_after(text, x, FOOTER_REACH, True, words), lambda b: F.slice(_pairs(b), 1, 1))), F.lit(0)) for x in FOOTERS]
    labelled = F.flatten(F.array(*(F.flatten(F.transform(_after(text, x, LABEL_REACH, False, words), lambda b: F.slice(_pairs(b), 1, 1))) for x in LABELS)))
    facts = F.struct(F.coalesce(*foot).alias("footer"), F.try_element_at(labelled, F.lit(-1)).alias("last"), line_sum(text).alias("lines"))

    def pick(f: Column) -> Column:
        last, lines = f["last"], f["lines"]
        far = ~close(lines["total"], last["total"]) & ~last["total"].between(lines["total"] * 0.5, lines["total"] * 1.5)
        wrong = F.coalesce((lines["currency"] == last["currency"]) & far, F.lit(False))
        return F.struct(F.coalesce(f["footer"], F.when(wrong, lines), last, lines).alias("picked"), (f["footer"].isNull() & lines.isNotNull() & (last.isNull() | wrong)).alias("estimated"))

    return let(facts, pick)


def invoice_total(text: Column) -> Column:
    """(currency, total) of choice."""
    return choice(text)["picked"]
