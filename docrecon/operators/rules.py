"""Business rules as conditional Columns, and their roll-up to a dossier's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import close, confusable

OK, NOK, WARN = "OK", "NOK", "WARN"


def check(code: str, status: Column, severity: Column | None = None) -> Column:
    """One check result; a status of null means that the rule gave none."""
    return F.struct(F.lit(code).alias("code"), status.alias("status"), (F.when(status == WARN, "WARN").otherwise("CRITICAL") if severity is None else severity).alias("severity"))


def entity(expected: Column, declared: Column, ours: Column, declared_all: Column, near: Column) -> tuple[Column, Column]:
    """(tva_scope, tva_match_decl) from the buyer's and the declared VAT, our VATs (an array), whether the declaration names all of ours, and whether amounts agree."""
    mine, known = F.coalesce(F.array_contains(ours, expected), F.lit(False)), F.coalesce(F.array_contains(ours, declared), F.lit(False))
    scope = F.when(expected.isNull(), F.when(known | declared_all, WARN).otherwise(NOK)).when(~mine, F.when(known & near, WARN).otherwise(NOK)).otherwise(OK)
    match = F.when(mine & declared_all, WARN).when(mine & F.coalesce(declared == expected, F.lit(False)), OK).when(mine, NOK)
    return scope, match


def value_currency(i_total: Column, i_currency: Column, d_total: Column, d_currency: Column, rate: Column, estimated: Column) -> tuple[Column, Column]:
    """(currency_match, amount_match): rate is the invoice currency's price of one EUR, estimated whether the total is a sum of lines."""
    differ = i_currency != d_currency
    fx = F.coalesce(differ & (d_currency == "EUR") & (rate > 0) & close(i_total / rate, d_total, 2.0, 0.25), F.lit(False))
    equal = F.coalesce(close(i_total, d_total, 1.0, 0.02), F.lit(False))
    currency = F.when(d_currency.isNull(), NOK).when(i_currency.isNull(), WARN).when(~differ, OK).when(fx, OK).when(equal, WARN).otherwise(NOK)
    value = F.when(fx, OK).when(d_total.isNull(), NOK).when(i_total.isNull(), WARN).when(equal, OK).when(estimated & (i_total < d_total), WARN).otherwise(NOK)
    return currency, value


def tariff(invoice: Column, declared: Column) -> Column:
    """hs_subset from arrays of six-digit codes: every invoice code is declared; a missing one that a declared one is confused with only warns."""
    missing = F.array_except(invoice, declared)
    hard = F.filter(missing, lambda m: ~F.exists(declared, lambda d: confusable(m, d)))
    return F.when(F.size(invoice) == 0, F.when(F.size(declared) > 0, WARN).otherwise(NOK)).when(F.size(declared) == 0, NOK).when(F.size(missing) == 0, OK).when(F.size(hard) == 0, WARN).otherwise(NOK)


def declared_duties(dd: Column, at: Column, tva: Column, tg: Column) -> Column:
    """A declaration's duties: the grand total where it exceeds its parts by more than 0.50 or stands alone."""
    parts = F.coalesce(dd, F.lit(0.0)) + F.coalesce(at, F.lit(0.0)) + F.coalesce(tva, F.lit(0.0))
    return F.when((parts == 0) & tg.isNull(), F.lit(None).cast("double")).when(tg > parts + 0.5, tg).otherwise(parts)


def duties(declared: Column, paid: Column) -> Column:
    return F.when(declared.isNull() | paid.isNull(), NOK).when(close(declared, paid, 0.5, 0.02), OK).otherwise(NOK)


def status(has_invoice: Column, has_declaration: Column, checks: Column) -> Column:
    """A dossier's status from its checks (an array): a missing document, then a critical failure, any failure, a warning."""
    any_ = lambda f: F.exists(checks, f)
    return F.when(~has_invoice | ~has_declaration, "MANQUE_DOC").when(any_(lambda c: (c["status"] == NOK) & (c["severity"] == "CRITICAL")), "KO_BLOQUANT").when(any_(lambda c: c["status"] == NOK), "KO").when(any_(lambda c: c["status"] == WARN), "OK_A_CONTROLER").otherwise("OK")


def summary(bundles: DataFrame) -> DataFrame:
    """Dossiers by status, and which statuses are anomalies."""
    counts = bundles.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("anomaly", F.col("status").isin("KO_BLOQUANT", "KO", "MANQUE_DOC"))
