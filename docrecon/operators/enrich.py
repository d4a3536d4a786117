"""Filling of invoices' fields in stages, each of which reads only what earlier ones left open, with where a value came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, tariff_code
from . import tariff, totals

# Words of papers that are no invoice of goods, by what they are; words of an invoice; words that decide alone.
NOT_GOODS = [
    ("processing", ["OUTWARD PROCESSING DECLARATION", "OP AUTHORISATION", "PLEASE EXPORT THIS SHIPMENT USING OUR OP AUTHORISATION"]),
    ("pre-alert", ["PRE ALERTE IMPORTATION", "PRÉ ALERTE IMPORTATION"]),
    ("repair list", ["REPAIR SHIPPING LIST"]),
    ("consent", ["DANS LE CAS D'UNE IMPORTATION", "DANS LE CAS D’UNE IMPORTATION", "VOTRE ACCORD POUR LE REGLEMENT DES DROITS", "VOTRE ACCORD POUR LE RÈGLEMENT DES DROITS"]),
    ("export", ["YOUR CDS REFERENCE NUMBER", "CERS EXPORT DECLARATION", "DECLARATION D'EXPORTATION SCDE", "DECLARATION D’EXPORTATION SCDE"]),
]
GOODS = ["PROFORMA INVOICE", "COMMERCIAL INVOICE", "INVOICE TOTAL", "TOTAL INVOICE AMOUNT", "TOTAL GOODS VALUE", "VALUE FOR CUSTOMS"]
DECISIVE = ["PRE ALERTE IMPORTATION", "OUTWARD PROCESSING DECLARATION", "REPAIR SHIPPING LIST"]
REPAIR_TABLE, NO_REPAIR = ["REQUEST ID", "CLIENT CASE", "SKU NUMBER"], ["VALUE FOR CUSTOMS", "COMMERCIAL INVOICE", "PROFORMA INVOICE"]
AWB_LABELS, AWB_NAME = ["AWB", "TRACKING", "TRACKING NO", "PARCEL NO"], r"\b(\d{10})_(?:INV|HWB|ENT)_"
#: A total up to TINY, or below a TIMESth of one read from the text, is no total.
TINY, TIMES = 5.0, 10


@dataclass(frozen=True)
class Limits:
    """What a client's tariff codes are held against: six-digit heads in scope (None: all), known numbers, prefixes that no code has."""

    scope: tuple[str, ...] | None = None
    known_ids: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()


def staged(stages: list[tuple[str, Column]]) -> Column:
    """A struct (value, source): the first value that is there, and the name of its stage. Later stages see only what is still open."""
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(name).alias("source"))) for name, v in stages))


def not_goods(text: Column) -> Column:
    """What a paper is that is no invoice of goods; null for an invoice, or without text."""
    up = F.upper(F.coalesce(text, F.lit("")))
    has = lambda words: F.array_contains(F.array(*(up.contains(w) for w in words)), True)
    all_of = lambda words: ~F.array_contains(F.array(*(up.contains(w) for w in words)), False)
    table = all_of(REPAIR_TABLE) & ~has(NO_REPAIR)
    other = has([w for _, words in NOT_GOODS for w in words]) & (~has(GOODS) | has(DECISIVE))
    reason = F
    for name, words in NOT_GOODS[:3]:
        reason = reason.when(has(words), name)
    return F.when(table | other, reason.when(all_of(REPAIR_TABLE), "repair table").otherwise("other paper"))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def enrich(invoices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """invoices with awb, hs_codes, currency and total filled from their own text, and how: awb_source, hs_source, total_source,
    currency_source, estimated, not_goods.

    invoices: text, path, number, awb, hs_codes (array), currency, total, and any other columns. A paper that is no invoice of goods keeps what it has.
    awb: read, by a label in the text, from the file's name. hs_codes: those read that are within limits; the text's where it
    prints split codes, or where none are left. total: the text's where there is none, it is tiny, or the text's is above ten
    times it; so for the currency. A delivery note without a total that never speaks of an invoice is no invoice of goods either.
    """
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<string>")
    label = r"(?iU)(?:" + "|".join(w.replace(" ", r"\s+") for w in AWB_LABELS) + r")\s*[:#.]?\s*(\d{8,12})"
    reason = not_goods(text)
    first = invoices.withColumn("not_goods", reason).withColumn("_awb", staged([("read", F.col("awb")), ("text", F.when(F.col("not_goods").isNull(), _first(text, label))), ("name", F.when(F.col("not_goods").isNull(), _first(F.element_at(F.split("path", "/"), -1), AWB_NAME)))]))
    first = first.withColumn("awb", F.col("_awb.value")).withColumn("awb_source", F.col("_awb.source")).drop("_awb")
    scope = None if limits.scope is None else list(limits.scope)

    def within(found: Column) -> Column:
        own = F.array(*(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\D", "") for c in ("awb", "number")))
        good = F.filter(F.transform(F.coalesce(found, none), tariff_code), lambda c: c.isNotNull() & ~F.array_contains(own, c) & ~tariff.look_alike(c, text, limits.known_ids, limits.prefixes))
        return F.array_distinct(good if scope is None else F.filter(good, lambda c: F.substring(c, 1, 6).isin(scope)))

    both = F.struct(within(F.col("hs_codes")).alias("read"), tariff.codes(text, F.col("awb"), scope, limits.known_ids, limits.prefixes).alias("text"))
    split = text.rlike(tariff.SPLIT_HEAD)
    chosen = lambda b: staged([("text", F.when(split & (F.size(b["text"]) > 0), b["text"])), ("read", F.when(F.size(b["read"]) > 0, b["read"])), ("text", F.when(F.size(b["text"]) > 0, b["text"]))])
    second = first.withColumn("_hs", F.when(F.col("not_goods").isNull(), let(both, chosen)).otherwise(staged([("read", F.when(F.size("hs_codes") > 0, F.col("hs_codes")))])))
    second = second.withColumn("_c", F.when(F.col("not_goods").isNull(), totals.choice(text)))
    found, total, much = F.col("_c.picked.total"), F.col("total"), F.coalesce(F.col("_c.picked.total") > F.col("total") * TIMES, F.lit(False))
    worse = total.isNull() | (total <= TINY) | much
    money = staged([("text", F.when(found.isNotNull() & worse, found)), ("read", total)])
    named = staged([("text", F.when(F.col("currency").isNull() | (much & (total != 0)), F.nullif(F.col("_c.picked.currency"), F.lit("")))), ("read", F.col("currency"))])
    third = second.withColumns({"_t": money, "_n": named})
    filled = {
        "hs_codes": F.coalesce("_hs.value", none),
        "hs_source": F.col("_hs.source"),
        "total": F.col("_t.value"),
        "total_source": F.col("_t.source"),
        "currency": F.col("_n.value"),
        "currency_source": F.col("_n.source"),
        "estimated": F.coalesce((F.col("_t.source") == "text") & F.col("_c.estimated"), F.lit(False)),
    }
    note = F.upper(text).contains("DELIVERY NOTE") & ~F.upper(text).contains("INVOICE") & F.col("total").isNull()
    out = third.withColumns(filled).drop("_hs", "_c", "_t", "_n")
    return out.withColumn("not_goods", F.coalesce("not_goods", F.when(note, "delivery note")))


def usable(invoices: DataFrame) -> DataFrame:
    """The invoices of goods."""
    return invoices.filter(F.col("not_goods").isNull())
